"""SimaPro method CSV: impact categories with factors, damage categories, normalisation and weighting sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .simapro import NAMESPACE, amount, cells, decode, header

# Media by the compartments' names; others stay as they are.
_MEDIA = {"air": "air", "water": "water", "soil": "soil", "raw": "natural resource", "resources": "natural resource"}
#: What a line may begin, and what its rows are.
_SECTIONS = {"Impact category": "category", "Substances": "factor", "Damage category": "damage", "Impact categories": "damage_part", "Normalization-Weighting set": "set", "Normalization": "normalization", "Weighting": "weighting"}
SCHEMA = "file string, kind string, method string, unit string, set_name string, flow_id string, substance string, cas string, medium string, sub string, is_input boolean, value double"


def is_method(text: str) -> bool:
    """A SimaPro header and, on the second line, the mark of a method export in any language."""
    lines = text.splitlines()[:2]
    return len(lines) == 2 and lines[0].startswith("{SimaPro") and lines[1][:2].lower() == "{m"


def parse(path: str, content: bytes) -> list[dict]:
    """One row for each factor (kind factor), category, damage category and its parts, normalisation and weighting value."""
    text = decode(content)
    style = header(text)
    section = name = unit = damage = nw = None
    fresh, out = False, []
    for raw in text.splitlines():
        line = raw.strip()
        if line.startswith("{"):
            continue
        if line in _SECTIONS:
            section, fresh = _SECTIONS[line], True
            continue
        if line == "End":
            section = None
        if not line:
            if not fresh and section in ("factor", "damage_part", "normalization", "weighting"):
                section = None
            continue
        c = [x.strip() for x in cells(raw, style.delimiter)]
        if section == "category" and fresh:
            name, unit = c[0], c[1] if len(c) > 1 else ""
            out.append({"file": path, "kind": "category", "method": name, "unit": unit})
        elif section == "factor" and name and len(c) >= 5:
            medium, sub = _MEDIA.get(c[0].lower(), c[0].lower()), "" if c[1] == "(unspecified)" else c[1]
            key = str(uuid.uuid5(NAMESPACE, f"flow:{c[2]}:{c[0]}/{c[1]}:kg"))
            out.append({"file": path, "kind": "factor", "method": name, "unit": unit, "flow_id": key, "substance": c[2], "cas": c[3] or None, "medium": medium, "sub": sub, "is_input": c[0].lower().startswith("raw") or c[0].lower() == "resources", "value": amount(c[4], style.decimal)})
        elif section == "damage" and fresh:
            damage = c[0]
            out.append({"file": path, "kind": "damage", "method": damage, "unit": c[1] if len(c) > 1 else ""})
        elif section == "damage_part" and damage and len(c) >= 2:
            out.append({"file": path, "kind": "damage_part", "set_name": damage, "method": c[0], "value": amount(c[1], style.decimal)})
        elif section == "set" and fresh:
            nw = c[0]
        elif section in ("normalization", "weighting") and len(c) >= 2:
            out.append({"file": path, "kind": section, "set_name": nw, "method": c[0], "value": amount(c[1], style.decimal)})
        fresh = False
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all method exports under path; other CSV files have none."""
    return files.read(spark, path, "*.{csv,CSV}", lambda p, c: parse(p, c) if is_method(decode(c[:300])) else [], SCHEMA)


def factors(rows: DataFrame) -> DataFrame:
    """(method, unit, flow_id, cf_name, cas, medium, sub, is_input, cf)."""
    return rows.where("kind = 'factor'").select("method", "unit", "flow_id", F.col("substance").alias("cf_name"), "cas", "medium", "sub", "is_input", F.col("value").alias("cf"))


def sets(rows: DataFrame) -> DataFrame:
    """(set_name, method, n, w): normalisation and weighting of each set; null where a set lacks one."""
    return rows.where("kind in ('normalization', 'weighting')").groupBy("set_name", "method").agg(F.max(F.when(F.col("kind") == "normalization", F.col("value"))).alias("n"), F.max(F.when(F.col("kind") == "weighting", F.col("value"))).alias("w"))


def damages(rows: DataFrame) -> DataFrame:
    """(damage, method, factor): the impact categories of each damage category."""
    return rows.where("kind = 'damage_part'").select(F.col("set_name").alias("damage"), "method", F.col("value").alias("factor"))
