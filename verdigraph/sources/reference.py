"""Reference data of a project: compartments, synonyms, places, and the configuration that names its parts."""

from __future__ import annotations

import os
import tempfile
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import _rows


def compartments(spark: SparkSession, text: str) -> DataFrame:
    """(medium, sub, qualifier, to_medium, to_sub, to_qualifier) of a file of six columns; keys in lower case, the last row of a key holds."""
    found = {}
    for r in _rows(text):
        cells = [*r, "", "", "", "", "", ""][:6]
        if any(cells[:3]):
            found[tuple(c.lower() for c in cells[:3])] = tuple(cells[3:])
    found.pop(next((k for k in found if k[0] in ("medium", "source_medium", "compartment")), None), None)
    return spark.createDataFrame([(*k, *v) for k, v in found.items()], "medium string, sub string, qualifier string, to_medium string, to_sub string, to_qualifier string")


def mapped(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (medium, sub) with their compartments replaced where the table has them."""
    own = table.where("qualifier = ''").select(F.col("medium").alias("k_medium"), F.col("sub").alias("k_sub"), "to_medium", "to_sub")
    joined = rows.join(F.broadcast(own), (F.lower("medium") == F.col("k_medium")) & (F.lower("sub") == F.col("k_sub")), "left")
    return joined.withColumn("medium", F.coalesce("to_medium", "medium")).withColumn("sub", F.coalesce("to_sub", "sub")).drop("k_medium", "k_sub", "to_medium", "to_sub")


def synonym_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of files of two names a line; a header "name" goes."""
    rows = spark.read.option("quote", '"').option("escape", '"').csv(path, schema="a string, b string")
    return rows.where("a is not null and b is not null and lower(a) not in ('name', 'name1', 'name_a')").select(F.trim("a").alias("a"), F.trim("b").alias("b"))


def pairs_csv(pairs: DataFrame) -> DataFrame:
    """The pairs as lines of a file: quoted where a name holds a comma, a quote or a line end."""

    def cell(c: Column) -> Column:
        return F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return pairs.select(F.concat_ws(",", cell(F.col("a")), cell(F.col("b"))).alias("value"))


def geographies(spark: SparkSession, path: str) -> DataFrame:
    """(code, display, parents) of lines code, display name (which may hold commas), ancestors parted by |."""
    cells = F.split("value", ",")
    lines = spark.read.text(path).where("trim(value) != '' and value not like '#%' and lower(value) not like 'code,%'")
    parents = F.filter(F.split(F.element_at(cells, -1), r"\|"), lambda p: F.trim(p) != "")
    return lines.select(F.trim(cells[0]).alias("code"), F.trim(F.array_join(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0))), ",")).alias("display"), F.transform(parents, F.trim).alias("parents"))


@dataclass
class Config:
    """What a configuration file says; entries keep their keys."""

    databases: list[dict] = field(default_factory=list)
    methods: list[dict] = field(default_factory=list)
    reference: dict[str, list[dict]] = field(default_factory=dict)
    presets: dict[str, list[tuple[str, str, bool]]] = field(default_factory=dict)
    scoring: list[dict] = field(default_factory=list)
    plugins: list[dict] = field(default_factory=list)
    server: dict = field(default_factory=dict)


#: Kinds of reference data by their tables in the file.
_REFERENCE = ("flow-synonyms", "compartment-mappings", "units", "geographies")


def load_config(path: str | os.PathLike, data_dir: str | None = None) -> Config:
    """The configuration of a TOML file; relative paths start at its folder, or at data_dir.

    Raises ValueError for databases without a name or path, names that come twice, and
    dependencies on databases that aren't there.
    """
    file = Path(path)
    raw = tomllib.loads(file.read_text("utf-8"))
    base = Path(data_dir) if data_dir else file.parent

    def placed(entry: dict) -> dict:
        return entry | {"path": str(base / entry["path"])} if "path" in entry else dict(entry)

    presets = {p["name"]: [(f["system"], f["value"], f.get("mode", "exact") == "exact") for f in p.get("filters", [])] for p in raw.get("classification-presets", [])}
    out = Config(
        [placed(d) for d in raw.get("databases", [])], [placed(m) for m in raw.get("methods", [])], {k: [placed(e) for e in raw[k]] for k in _REFERENCE if k in raw},
        presets, raw.get("scoring-sets", []), raw.get("plugins", []), raw.get("server", {}),
    )
    names = [d.get("name") for d in out.databases]
    for d in out.databases:
        if not d.get("name") or not d.get("path"):
            raise ValueError(f"a database needs a name and a path: {d}")
        if lost := [n for n in d.get("depends", []) if n not in names]:
            raise ValueError(f"{d['name']} depends on {', '.join(lost)}, which the file does not name")
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"named twice: {', '.join(sorted(twice))}")
    return out


def _toml(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f'"{k}" = {_toml(v)}' for k, v in value.items()) + "}"
    text = str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return f'"{text}"'


def write_config(path: str | os.PathLike, tables: dict[str, list[dict]]) -> None:
    """Writes arrays of tables to a TOML file, which changes in one step: a reader sees the old or the new one."""
    lines = []
    for name, entries in tables.items():
        for entry in entries:
            lines += [f"[[{name}]]", *(f'"{k}" = {_toml(v)}' for k, v in entry.items() if v is not None), ""]
    file = Path(path)
    fd, part = tempfile.mkstemp(dir=file.parent, prefix=file.name)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    os.replace(part, file)


def group_names(groups: DataFrame) -> DataFrame:
    """(gid, members): synonym groups for showing."""
    return groups.groupBy("gid").agg(F.array_sort(F.collect_set(T.squeeze(F.col("norm_name")))).alias("members"))
