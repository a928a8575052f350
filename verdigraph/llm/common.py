"""What the text operators share: tables, scratch tables and byte-level word arrays."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker turns into arrays at a time: they take some forty bytes for each.
SLICE_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at a time, one row at least. Its own bound is by
#: records, and thousands of long texts are held several times over, in the JVM and in the worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; a cluster's is refused, as its
    executors would not see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "verdigraph-shared")
    return found.rstrip("/")


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in taken:
            k += 1
            name = f"{stem}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES.

    Spark reads the bound from the session when the plan runs, so the session keeps it; a smaller one stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(key, None)
    if held is None or not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    Spark's own writer commits them. They go at the end of the session, or with drop().
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/vg-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: the shared folder goes with its cluster
            pass


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges of at most so many bytes of text each, one row at least."""
    sizes = np.diff(offsets_of(column)[1])
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on, and would keep its largest batch's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: The C library's own call, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls; null is the empty text. Called for each batch, it gives back what the last one held."""
    give_back()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_string()).fill_null("")


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array and the rows' offsets into them."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: A-Z to a-z, other bytes as they are; and the white space bytes \x20 and \x09-\x0D.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = np.random.default_rng(20260107).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(column: pa.Array, lower: bool = True, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, or runs of the bytes not in between, as arrays over the whole column.

    Returns the words' 64-bit hashes, the first word of each row (one entry more than
    rows), the words' start bytes and the bytes.
    """
    raw, off = offsets_of(column)
    space = between[raw]
    begins = ~space
    if len(raw):
        begins[1:] &= space[:-1]
        edges = off[:-1][off[:-1] < len(raw)]
        begins[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, raw
    word = np.cumsum(begins, dtype=np.int32)
    word -= 1
    np.maximum(word, 0, out=word)
    place = np.arange(len(raw), dtype=np.int64) - starts[word]
    values = (_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)
    values *= _PLACE[place & 255]
    far = np.flatnonzero(place > 255)
    if len(far):  # every place has its own multiplier, or words that differ 256 bytes apart could hash alike
        values[far] *= mix64(place[far].astype(np.uint64) + _PLACE[0]) | np.uint64(1)
    values[space] = 0
    return mix64(np.add.reduceat(values, starts)), first, starts, raw
