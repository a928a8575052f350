"""EcoSpold 1 files: any number of datasets in each; attributes hold everything."""

from __future__ import annotations

import uuid
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from . import files
from .elements import child, children, descendants, number, text

#: Ids are name-based; an exchange's flow has one of its own in each dataset.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "ecospold1.ecoinvent.org")


def _id(key: str) -> str:
    return str(uuid.uuid5(NAMESPACE, key))


def _dataset(path: str, data: ET.Element) -> list[dict]:
    about = child(data, "metaInformation", "processInformation")
    function, place = child(about, "referenceFunction"), child(about, "geography")
    what = function.attrib if function is not None else {}
    name, location = what.get("name", ""), (place.get("location") if place is not None else None) or "GLO"
    dataset = int(number(data.get("number"), 0) or 0)
    classes = {k: v for k, v in (("Category", what.get("category")), ("SubCategory", what.get("subCategory"))) if v}
    base = {"file": path, "act_id": _id(f"{name}:{location}"), "act_name": name, "act_location": location, "act_unit": what.get("unit") or "UNKNOWN_UNIT", "classes": classes, "number": dataset, "comment": what.get("generalComment")}
    out = []
    for seq, e in enumerate(children(child(data, "flowData"), "exchange")):
        taken, given = text(child(e, "inputGroup")), text(child(e, "outputGroup"))
        bio = "4" in (taken, given)
        code = int(number(e.get("number"), 0) or 0)
        category, sub = e.get("category", ""), e.get("subCategory")
        out.append(
            base
            | {"seq": seq, "kind": "biosphere" if bio else "technosphere", "flow_id": _id(f"{dataset}:{code}:{e.get('name', '')}:{category}"), "flow_name": e.get("name", ""), "cas": e.get("CASNumber")}
            | {"category": f"{category}/{sub}" if sub else category, "subcompartment": sub, "amount": number(e.get("meanValue")), "unit": e.get("unit") or "UNKNOWN_UNIT", "location": e.get("location")}
            | {"is_input": bool(taken), "is_reference": not bio and given == "0", "supplier_number": code if taken and not bio else None, "comment": e.get("generalComment")}
        )
    return out or [base | {"error": "no exchanges"}]


def parse(path: str, content: bytes) -> list[dict]:
    """The exchanges of all datasets of one file; a file that can't be read gives one row with its error."""
    try:
        found = [row for data in descendants(ET.fromstring(content), "dataset") for row in _dataset(path, data)]
        return found or [{"file": path, "error": "no dataset"}]
    except ET.ParseError as e:
        return [{"file": path, "error": f"{type(e).__name__}: {e}"}]


def read(spark: SparkSession, path: str) -> DataFrame:
    return files.read(spark, path, "*.{xml,XML}", parse, files.EXCHANGES)
