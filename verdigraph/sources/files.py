"""Files of a folder read by file in parallel: one function makes the rows of one file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ARROW = {T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.MapType):
        return pa.map_(_arrow(kind.keyType), _arrow(kind.valueType))
    return _ARROW[kind]


def read(spark: SparkSession, path: str, pattern: str, parse: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """The rows that parse(path, content) makes of each file under path whose name matches; missing keys are null.

    A file is one task's work at most, so it has to fit in a worker; rows leave it a thousand at a time.
    """
    fields = T.StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column(0), batch.column(1), strict=True):
                found = parse(p.as_py(), c.as_py())
                for k in range(0, len(found), 1000):
                    yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in arrow} for r in found[k : k + 1000]], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(rows, fields)


#: What every reader of process data gives: one row for each exchange, with its activity's columns.
EXCHANGES = """file string, error string, act_id string, act_name string, act_location string, act_unit string, classes map<string,string>, number long,
 seq int, kind string, flow_id string, flow_name string, category string, subcompartment string, cas string, amount double, unit string,
 is_input boolean, is_reference boolean, link string, supplier_number long, location string, comment string"""
