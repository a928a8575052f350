"""Reference data in CSV: units, methods with one column each, normalisation and weighting."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession

from ..functions import units


def _rows(text: str) -> list[list[str]]:
    """Cells of a small file: the delimiter is the one of ; and , that its first lines have more of; comment lines go."""
    lines = [line for line in text.lstrip("﻿").splitlines() if line.strip() and not line.startswith("#")]
    head = "\n".join(lines[:3])
    return [[c.strip() for c in row] for row in csv.reader(io.StringIO("\n".join(lines)), delimiter=";" if head.count(";") >= head.count(",") else ",")]


def number(text: str, default: float | None = None) -> float | None:
    """A number with decimal point or comma; default where it is none."""
    try:
        return float(text.replace(",", "."))
    except ValueError:
        return default


def unit_table(spark: SparkSession, *texts: str) -> DataFrame:
    """unit_defs of files of name, dimension, factor; later files win."""
    rows = [r[:3] for t in texts for r in _rows(t) if len(r) >= 3 and number(r[2]) is not None]
    return units.from_rows(spark, [(n, d, number(f)) for n, d, f in rows])


def weighting(spark: SparkSession, text: str) -> DataFrame:
    """(category, normalization, weighting) with 0 for what is missing; the header goes."""
    rows = [(r[0], number(r[1], 0.0) if len(r) > 1 else 0.0, number(r[2], 0.0) if len(r) > 2 else 0.0) for r in _rows(text) if r[0]]
    if rows and rows[0][0].lower() in ("category", "impact category", "name"):
        rows = rows[1:]
    return spark.createDataFrame(rows, "category string, normalization double, weighting double")


def methods(spark: SparkSession, text: str, first: int = 2) -> tuple[DataFrame, DataFrame]:
    """methods (method, category, unit) and factors (method, substance, compartment, value) of a wide table.

    Columns from first on are methods: a row of names, one of units, and before these maybe
    one of categories; a row of labels may follow. Blank cells are absent, 0 is a factor.
    """
    rows = _rows(text)
    split = next((i for i, r in enumerate(rows) if r[0] and any(number(c) is not None for c in r[first:])), len(rows))
    head = [r for r in rows[:split] if not any(r[0].lower() == w for w in ("substance", "flow", "name"))]
    names, unit = (head[-2], head[-1]) if len(head) >= 2 else (head[0], [""] * len(head[0]))
    category = head[-3] if len(head) >= 3 else names
    at = [i for i in range(first, len(names)) if names[i]]
    cell = lambda r, i: r[i] if i < len(r) else ""
    about = [(names[i], cell(category, i) or names[i], cell(unit, i)) for i in at]
    factors = [(names[i], r[0], r[1] if len(r) > 1 else "", number(cell(r, i))) for r in rows[split:] for i in at if number(cell(r, i)) is not None]
    return spark.createDataFrame(about, "method string, category string, unit string"), spark.createDataFrame(factors, "method string, substance string, compartment string, value double")
