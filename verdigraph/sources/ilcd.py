"""ILCD packages: unit groups, flow properties, flows and processes as four tables and three joins."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .elements import child, children, descendants, number, text


def _parsed(parse):
    """parse(root) -> rows, for one file; none where it can't be read."""

    def rows(path: str, content: bytes) -> list[dict]:
        try:
            return [{"file": path} | r for r in parse(ET.fromstring(content))]
        except ET.ParseError:
            return []

    return rows


def _uuid(root: ET.Element) -> str:
    return text(next(descendants(root, "UUID"), None)).lower()


def _unit_group(root: ET.Element) -> list[dict]:
    reference = text(next(descendants(root, "referenceToReferenceUnit"), None))
    found = [u for u in descendants(root, "unit") if u.get("dataSetInternalID") == reference]
    return [{"group_id": _uuid(root), "unit": text(child(found[0], "name")) if found else "kg"}]


def _property(root: ET.Element) -> list[dict]:
    group = next(descendants(root, "referenceToReferenceUnitGroup"), None)
    return [{"property_id": _uuid(root), "group_id": (group.get("refObjectId") or "").lower() if group is not None else None}]


def _flow(root: ET.Element) -> list[dict]:
    about = child(root, "flowInformation", "dataSetInformation")
    levels = sorted((int(c.get("level") or 0), text(c)) for c in descendants(about, "category"))
    medium, sub = compartment([t for _, t in levels])
    reference = text(next(descendants(child(root, "flowInformation"), "referenceToReferenceFlowProperty"), None)) or "0"
    held = [p for p in descendants(child(root, "flowProperties"), "flowProperty") if p.get("dataSetInternalID") == reference]
    target = child(held[0], "referenceToFlowPropertyDataSet") if held else None
    synonyms = [s.strip() for s in text(next(descendants(about, "synonyms"), None)).split(";") if s.strip()]
    kind = text(next(descendants(root, "typeOfDataSet"), None))
    return [
        {"flow_id": _uuid(root), "flow_name": text(child(about, "name", "baseName")), "cas": text(next(descendants(about, "CASNumber"), None)) or None, "synonyms": synonyms, "elementary": kind == "Elementary flow"}
        | {"property_id": (target.get("refObjectId") or "").lower() if target is not None else None, "medium": medium, "sub": sub}
    ]


def compartment(levels: list[str]) -> tuple[str, str]:
    """Medium and inner compartment of a flow's categories: "Emissions", "Emissions to air", ... or "Resources", ..."""
    low = [x.lower() for x in levels]
    if not low:
        return "", ""
    if low[0].startswith("resource"):
        return "natural resource", low[1].removeprefix("resources ").strip() if len(low) > 1 else ""
    medium = low[1].removeprefix("emissions to ").split(",")[0].strip() if len(low) > 1 else low[0]
    inner = low[2].removeprefix(f"emissions to {medium}").strip(" ,") if len(low) > 2 else ""
    return medium, inner


def _process(root: ET.Element) -> list[dict]:
    about = child(root, "processInformation")
    data = child(about, "dataSetInformation")
    place = next(iter([*descendants(about, "locationOfOperationSupplyOrProduction"), *descendants(about, "geography")]), None)
    classes = {f"level {c.get('level')}": text(c) for c in descendants(data, "class")}
    reference = text(next(descendants(about, "referenceToReferenceFlow"), None))
    base = {"act_id": _uuid(root), "act_name": text(child(data, "name", "baseName")), "act_location": (place.get("location") if place is not None else None) or "GLO", "classes": classes}
    out = []
    for seq, e in enumerate(children(child(root, "exchanges"), "exchange")):
        flow = child(e, "referenceToFlowDataSet")
        n = number(text(child(e, "resultingAmount")), None)
        out.append(
            base
            | {"seq": seq, "flow_id": (flow.get("refObjectId") or "").lower() if flow is not None else None, "is_input": text(child(e, "exchangeDirection")).lower() == "input"}
            | {"amount": n if n is not None else number(text(child(e, "meanAmount"))), "is_reference": e.get("dataSetInternalID") == reference, "location": text(child(e, "location")) or None}
        )
    return out


def flows(spark: SparkSession, path: str) -> DataFrame:
    """(flow_id, flow_name, cas, synonyms, elementary, medium, sub, unit): flows with the unit of their reference property; kg where none is known."""
    rows = files.read(spark, f"{path}/flows", "*.xml", _parsed(_flow), "file string, flow_id string, flow_name string, cas string, synonyms array<string>, elementary boolean, property_id string, medium string, sub string")
    properties = files.read(spark, f"{path}/flowproperties", "*.xml", _parsed(_property), "file string, property_id string, group_id string").drop("file")
    groups = files.read(spark, f"{path}/unitgroups", "*.xml", _parsed(_unit_group), "file string, group_id string, unit string").drop("file")
    joined = rows.drop("file").join(properties, "property_id", "left").join(groups, "group_id", "left")
    return joined.select("flow_id", "flow_name", "cas", "synonyms", "elementary", "medium", "sub", F.coalesce("unit", F.lit("kg")).alias("unit"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The exchanges of a package's processes; a flow that isn't there is a product in kg without a name."""
    rows = files.read(spark, f"{path}/processes", "*.xml", _parsed(_process), "file string, act_id string, act_name string, act_location string, classes map<string,string>, seq int, flow_id string, is_input boolean, amount double, is_reference boolean, location string")
    joined = rows.join(flows(spark, path), "flow_id", "left")
    bio = F.coalesce("elementary", F.lit(False))
    category = F.when(bio, F.when(F.coalesce("sub", F.lit("")) != "", F.concat_ws("/", "medium", "sub")).otherwise(F.col("medium")))
    return joined.select(
        "file", "act_id", "act_name", "act_location", "classes", "seq", F.when(bio, "biosphere").otherwise("technosphere").alias("kind"), "flow_id", "flow_name", category.alias("category"),
        "cas", "amount", F.coalesce("unit", F.lit("kg")).alias("unit"), "is_input", (F.col("is_reference") & ~bio).alias("is_reference"), "location", "synonyms",
    )


def link(exchanges: DataFrame) -> DataFrame:
    """Exchanges with link: the last activity by id whose reference flow an input's flow is."""
    made = exchanges.where("is_reference").groupBy("flow_id").agg(F.max("act_id").alias("maker"))
    rows = exchanges.join(made, "flow_id", "left")
    return rows.withColumn("link", F.when((F.col("kind") == "technosphere") & F.col("is_input"), F.col("maker"))).drop("maker")


def _method(root: ET.Element) -> list[dict]:
    about = child(root, "LCIAMethodInformation", "dataSetInformation")
    unit = next(descendants(root, "referenceQuantity"), None)
    base = {"method": text(next(descendants(about, "name"), None)), "method_id": _uuid(root), "category": text(next(descendants(about, "impactCategory"), None)), "unit": text(next(iter(descendants(unit, "shortDescription")), None))}
    out = []
    for e in descendants(root, "factor"):
        flow = child(e, "referenceToFlowDataSet")
        said = text(next(descendants(flow, "shortDescription"), None))
        name, _, rest = said.partition(" (")
        direction = text(child(e, "exchangeDirection")).lower()
        out.append(base | {"flow_id": (flow.get("refObjectId") or "").lower() if flow is not None else None, "said": name.strip(), "said_place": rest.rstrip(")").strip() or None, "is_input": direction == "input", "cf": number(text(child(e, "meanValue")))})
    return out


def methods(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(method, method_id, category, unit, flow_id, cf_name, cas, medium, sub, is_input, cf): factors, by known flows() in full, else by their short descriptions."""
    rows = files.read(spark, path, "*.xml", _parsed(_method), "file string, method string, method_id string, category string, unit string, flow_id string, said string, said_place string, is_input boolean, cf double")
    if known is None:
        known = spark.createDataFrame([], "flow_id string, flow_name string, cas string, medium string, sub string")
    joined = rows.join(known.select("flow_id", "flow_name", "cas", F.col("medium").alias("k_medium"), "sub"), "flow_id", "left")
    place = F.regexp_replace(F.lower("said_place"), "^emissions to ", "")
    return joined.select("method", "method_id", "category", "unit", "flow_id", F.coalesce("flow_name", "said").alias("cf_name"), "cas", F.coalesce("k_medium", F.trim(F.split(place, ",")[0])).alias("medium"), F.coalesce("sub", F.lit("")).alias("sub"), "is_input", "cf")
