"""EcoSpold 2 files: one activity in each, read by file in parallel.

read() gives the exchanges with their activity's columns; activities(), flows() and the
cut-off rule work on them as DataFrames.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = """file string, error string, act_id string, prod_id string, act_name string, act_location string, seq int, kind string, flow_id string,
 flow_name string, category string, subcompartment string, cas string, amount double, unit string, is_input boolean, is_reference boolean, link string, comment string, synonyms array<string>"""
_NAMES = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_NIL = "00000000-0000-0000-0000-000000000000"


def _id(text: str, namespace: uuid.UUID) -> str:
    """A UUID as it is, any other text as a name-based one."""
    low = text.strip().lower()
    return low if _UUID.fullmatch(low) else str(uuid.uuid5(namespace, text.strip()))


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if _tag(c) == name), None) if e is not None else None
    return e


def _text(e: ET.Element | None) -> str:
    return "".join(e.itertext()).strip() if e is not None else ""


def _number(text: str | None) -> float:
    try:
        return float(text or 0)
    except ValueError:
        return 0.0


def _exchange(e: ET.Element, kind: str) -> dict:
    inside = {"input": _text(_child(e, "inputGroup")), "output": _text(_child(e, "outputGroup"))}
    row = {"kind": kind, "flow_name": _text(_child(e, "name")), "amount": _number(e.get("amount")), "unit": _text(_child(e, "unitName")) or "UNKNOWN_UNIT", "comment": _text(_child(e, "comment")) or None, "cas": e.get("casNumber"), "link": None}
    row["synonyms"] = [_text(c) for c in e if _tag(c) == "synonym" and _text(c)]
    if kind == "technosphere":
        row |= {"flow_id": e.get("intermediateExchangeId"), "is_input": bool(inside["input"]), "category": None, "subcompartment": None}
        row["is_reference"] = not row["is_input"] and inside["output"] == "0"
        row["link"] = e.get("activityLinkId") if e.get("activityLinkId") != _NIL else None
    else:
        medium, sub = _text(_child(e, "compartment", "compartment")), _text(_child(e, "compartment", "subcompartment"))
        row |= {"flow_id": e.get("elementaryExchangeId"), "category": f"{medium}/{sub}" if sub else medium, "subcompartment": sub or None, "is_reference": False}
        row["is_input"] = True if inside["input"] else False if inside["output"] else medium.lower() == "natural resource"
    return row


def parse(path: str, content: bytes, namespace: uuid.UUID) -> list[dict]:
    """The exchanges of one file; a file that can't be read gives one row with its error."""
    stem = posixpath.basename(unquote(path)).rsplit(".", 1)[0]
    act, _, prod = stem.partition("_")
    base = {"file": path, "act_id": _id(act, namespace), "prod_id": _id(prod or act, namespace)}
    try:
        root = ET.fromstring(content)
        data = root if _tag(root).endswith("ActivityDataset") else next((c for c in root if _tag(c).endswith("ctivityDataset")), None)
        if data is None:
            raise ValueError("no activity data set")
        about = _child(data, "activityDescription")
        base |= {"act_name": _text(_child(about, "activity", "activityName")), "act_location": _text(_child(about, "geography", "shortname")) or "GLO"}
        kinds = {"intermediateExchange": "technosphere", "elementaryExchange": "biosphere"}
        flow_data = _child(data, "flowData")
        rows = [base | {"seq": i} | _exchange(e, kinds[_tag(e)]) for i, e in enumerate(flow_data if flow_data is not None else []) if _tag(e) in kinds]
        return rows or [base | {"error": "no exchanges"}]
    except (ET.ParseError, ValueError) as e:
        return [base | {"error": f"{type(e).__name__}: {e}"}]


def read(spark: SparkSession, path: str, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> DataFrame:
    """All exchanges of the .spold files under path; rows with an error stand for unreadable files."""
    kinds = {"seq": pa.int32(), "amount": pa.float64(), "is_input": pa.bool_(), "is_reference": pa.bool_(), "synonyms": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in _NAMES])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in _NAMES} for r in parse(p.as_py(), c.as_py(), namespace)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.spold").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(rows, SCHEMA)


def cut_off(exchanges: DataFrame) -> DataFrame:
    """The exchanges by the cut-off rule: other outputs of amount 0 go; a lone output that isn't 0 becomes the reference where there is none; activities still without one go."""
    act = Window.partitionBy("act_id", "prod_id")
    output = (F.col("kind") == "technosphere") & ~F.col("is_input")
    rows = exchanges.where("error is null").where(~(output & ~F.col("is_reference") & (F.col("amount") == 0)))
    rows = rows.withColumn("vg_refs", F.count_if(F.col("is_reference")).over(act)).withColumn("vg_outs", F.count_if(output & (F.col("amount") != 0)).over(act))
    lone = (F.col("vg_refs") == 0) & (F.col("vg_outs") == 1) & output
    return rows.withColumn("is_reference", F.col("is_reference") | lone).where("vg_refs > 0 or vg_outs = 1").drop("vg_refs", "vg_outs")


def rejected(exchanges: DataFrame) -> DataFrame:
    """(act_id, prod_id, file) of activities that the cut-off rule leaves out, and of unreadable files."""
    kept = cut_off(exchanges).select("act_id", "prod_id").distinct()
    return exchanges.select("act_id", "prod_id", "file").distinct().join(kept, ["act_id", "prod_id"], "left_anti")


def flows(exchanges: DataFrame) -> DataFrame:
    """(flow_id, name, category, unit, cas, synonyms): one row for each flow, with the synonyms of all its mentions."""
    rows = exchanges.where("flow_id is not null")
    first = F.min_by(F.struct("flow_name", "category", "unit", "cas"), F.struct("file", "seq")).alias("f")
    found = rows.groupBy("flow_id").agg(first, F.array_sort(F.array_distinct(F.flatten(F.collect_set("synonyms")))).alias("synonyms"))
    return found.select("flow_id", F.col("f.flow_name").alias("name"), "f.category", "f.unit", "f.cas", "synonyms")
