"""One reader for any folder or archive of process data: the format is found, the rows have one shape."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, ecospold1, ecospold2, ilcd, simapro, simapro_methods

#: The columns that every format gives, in order; what a format lacks is null.
COLUMNS = {
    "file": "string", "error": "string", "act_id": "string", "act_name": "string", "act_location": "string", "seq": "int", "kind": "string", "flow_id": "string", "flow_name": "string", "category": "string",
    "cas": "string", "amount": "double", "unit": "string", "is_input": "boolean", "is_reference": "boolean", "link": "string", "location": "string", "synonyms": "array<string>",
}


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in COLUMNS.items()])


def read(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The format of the data at a local path, archives unpacked, and its exchanges with links where the format gives them."""
    place = Path(path) if Path(path).is_dir() else archives.extract(Path(path))
    found = archives.data_format(place)
    if found == "ecospold2":
        rows = ecospold2.read(spark, str(place))
        rows = rows.withColumn("location", F.lit(None).cast("string"))
    elif found == "ecospold1":
        rows = ecospold1.read(spark, str(place))
    elif found == "simapro":
        rows = simapro.link(simapro.read(spark, str(place)))
    elif found == "ilcd":
        root = next(p.parent for p in [place / "processes", *place.rglob("processes")] if p.is_dir())
        rows = ilcd.link(ilcd.read(spark, str(root)))
    else:
        raise ValueError(f"{path} holds no process data that is known here")
    return found, _shaped(rows)


def flows(*databases: DataFrame) -> DataFrame:
    """(flow_id, name, category, unit, cas, synonyms): one row for each flow of all the databases' exchanges, the first one's, with the synonyms of all."""
    every = None
    for order, rows in enumerate(databases):
        own = rows.where("flow_id is not null").select("flow_id", F.lit(order).alias("order"), "file", "seq", "flow_name", "category", "unit", "cas", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))
        every = own if every is None else every.unionByName(own)
    first = F.min_by(F.struct("flow_name", "category", "unit", "cas"), F.struct("order", "file", "seq")).alias("f")
    found = every.groupBy("flow_id").agg(first, F.array_sort(F.array_distinct(F.flatten(F.collect_set("synonyms")))).alias("synonyms"))
    return found.select("flow_id", F.col("f.flow_name").alias("name"), "f.category", "f.unit", "f.cas", "synonyms")


def methods(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(method, unit, flow_id, cf_name, cas, medium, sub, is_input, cf): the factors of all ILCD and SimaPro methods under path."""
    columns = ["method", "unit", "flow_id", "cf_name", "cas", "medium", "sub", "is_input", "cf"]
    place = Path(path)
    parts = []
    if any(place.rglob("*.xml")):
        parts.append(ilcd.methods(spark, path, known).select(*columns))
    if any(place.rglob("*.csv")):
        parts.append(simapro_methods.factors(simapro_methods.read(spark, path)).select(*columns))
    if not parts:
        raise ValueError(f"{path} holds no methods")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
