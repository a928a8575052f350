"""Databases, methods and reference data of a session: loaded with what they need, kept as Parquet, listed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dependencies

#: Changes when the tables' meaning does, so that old caches aren't read.
VERSION = 1


class NotLinked(ValueError):
    """A database has inputs without a supplier."""


def signature(df: DataFrame) -> str:
    return hashlib.sha256(f"{VERSION}:{df.schema.json()}".encode()).hexdigest()[:16]


def save(df: DataFrame, path: str) -> None:
    """The table as Parquet (zstd), with what it is beside it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps({"signature": signature(df)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """A saved table, or None where there is none or it is another version's."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/_SUCCESS")) or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_meta")):
        return None
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/_meta").collect()) or "{}")
    df = spark.read.parquet(f"{path}/data")
    return df if meta.get("signature") == signature(df) else None


@dataclass
class Entry:
    """A database that can be loaded: read() gives its exchanges."""

    read: Callable[[], DataFrame]
    needs: tuple[str, ...] = ()
    transforms: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    cache: str | None = None


@dataclass
class Session:
    """What is known and what is loaded. A staged database is known by its exchanges only and can't be used yet."""

    spark: SparkSession
    entries: dict[str, Entry] = field(default_factory=dict)
    loaded: dict[str, DataFrame] = field(default_factory=dict)
    staged: dict[str, tuple[DataFrame, tuple[str, ...]]] = field(default_factory=dict)
    methods: dict[str, DataFrame] = field(default_factory=dict)
    reference: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    tables: dict[tuple, DataFrame] = field(default_factory=dict)

    def _needs(self) -> dict[str, tuple[str, ...]]:
        return {n: e.needs for n, e in self.entries.items()}

    def _read(self, name: str) -> DataFrame:
        entry = self.entries[name]
        if entry.cache and (kept := load(self.spark, entry.cache)) is not None:
            return kept
        rows = entry.read()
        for change in entry.transforms:
            rows = rows.transform(change)
        if entry.cache:
            save(rows, entry.cache)
            rows = load(self.spark, entry.cache)
        return rows

    def load(self, *names: str) -> list[str]:
        """Loads databases and all they need, those of a level side by side; returns the names in order."""
        order = []
        for level in dependencies.levels(names, self._needs()):
            new = [n for n in level if n not in self.loaded]
            with ThreadPoolExecutor(max(1, len(new))) as pool:
                self.loaded |= dict(zip(new, pool.map(self._read, new), strict=True))
            order += new
        return order

    def unload(self, name: str) -> None:
        """Raises DependencyError while a loaded database needs it."""
        if users := dependencies.dependents(name, self.loaded, self._needs()):
            raise dependencies.DependencyError(f"{name} is needed by {', '.join(users)}")
        self.loaded.pop(name, None)
        self.tables = {k: v for k, v in self.tables.items() if k[0] != name}

    def remove(self, name: str) -> None:
        self.unload(name)
        self.entries.pop(name, None)

    def relink(self, name: str, link: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]) -> DataFrame:
        """Links of a loaded database anew, by link(exchanges, the databases it needs); its users' tables are forgotten too."""
        need = {n: self.loaded[n] for n in self.entries[name].needs if n in self.loaded}
        self.loaded[name] = link(self.loaded[name], need)
        stale = {name, *dependencies.dependents(name, self.loaded, self._needs())}
        self.tables = {k: v for k, v in self.tables.items() if k[0] not in stale}
        return self.loaded[name]

    def stage(self, name: str, rows: DataFrame, needs: tuple[str, ...] = ()) -> None:
        self.staged[name] = (rows, needs)

    def add_need(self, name: str, need: str) -> None:
        rows, needs = self.staged[name]
        if need not in self.entries:
            raise dependencies.DependencyError(f"no database {need}")
        self.staged[name] = (rows, tuple(dict.fromkeys((*needs, need))))

    def drop_need(self, name: str, need: str) -> None:
        rows, needs = self.staged[name]
        self.staged[name] = (rows, tuple(n for n in needs if n != need))

    def finalize(self, name: str) -> None:
        """A staged database becomes a loaded one; raises without activities, or NotLinked with open inputs."""
        rows, needs = self.staged[name]
        if rows.select("act_id").where("act_id is not null").isEmpty():
            raise ValueError(f"{name} has no activities")
        self.gate(rows)
        self.load(*needs)
        self.entries[name] = Entry(lambda: rows, needs)
        self.loaded[name] = rows
        del self.staged[name]

    @staticmethod
    def gate(rows: DataFrame) -> None:
        """Refuses a database with technosphere inputs that have no supplier."""
        open_ = rows.where("kind = 'technosphere' and is_input and link is null").count()
        if open_:
            raise NotLinked(f"{open_} inputs have no supplier")

    def status(self) -> DataFrame:
        """(name, status, needs): unloaded, staged, partially_linked or loaded."""
        rows = [(n, self._state(n), list(e.needs)) for n, e in sorted(self.entries.items())]
        rows += [(n, "staged", list(needs)) for n, (_, needs) in sorted(self.staged.items())]
        return self.spark.createDataFrame(rows, "name string, status string, needs array<string>")

    def _state(self, name: str) -> str:
        if name not in self.loaded:
            return "unloaded"
        linked = self.loaded[name].where("kind = 'technosphere' and is_input and link is null").isEmpty()
        return "loaded" if linked else "partially_linked"

    def add_methods(self, name: str, factors: DataFrame) -> None:
        self.methods[name] = factors
        self.tables = {k: v for k, v in self.tables.items() if k[1] != name}

    def drop_methods(self, name: str) -> None:
        self.methods.pop(name, None)
        self.tables = {k: v for k, v in self.tables.items() if k[1] != name}

    def method_list(self) -> DataFrame:
        """(collection, method, factors)."""
        out = None
        for name, factors in sorted(self.methods.items()):
            own = factors.groupBy("method").agg(F.count("*").alias("factors")).select(F.lit(name).alias("collection"), "method", "factors")
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], "collection string, method string, factors long")

    def mapping(self, db: str, collection: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """make(exchanges, factors), made once for a database and a collection."""
        key = (db, collection)
        if key not in self.tables:
            self.tables[key] = make(self.loaded[db], self.methods[collection])
        return self.tables[key]

    def set_reference(self, kind: str, name: str, table: DataFrame | None) -> None:
        """Adds a table of reference data, or with None takes it out; what was made of it is forgotten."""
        tables = self.reference.setdefault(kind, {})
        if table is None:
            tables.pop(name, None)
        else:
            tables[name] = table
        self.tables.clear()

    def merged_reference(self, kind: str, key: list[str]) -> DataFrame | None:
        """All tables of a kind in one; of a key the table that was added last holds."""
        out = None
        for order, table in enumerate(self.reference.get(kind, {}).values()):
            own = table.withColumn("vg_order", F.lit(order))
            out = own if out is None else out.unionByName(own)
        if out is None:
            return None
        rest = [c for c in out.columns if c not in key and c != "vg_order"]
        return out.groupBy(*key).agg(*[F.max_by(c, "vg_order").alias(c) for c in rest])
