"""Sorted pages of a result, with what a caller needs to turn them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _orders(by: str, descending: bool, tie: str) -> list[Column]:
    return [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), F.col(tie).asc_nulls_last()]


def page(rows: DataFrame, by: str, tie: str, *, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """rows in order from offset on, limit of them, with total and has_more; offsets below 0 count as 0.

    The page is a top-k of offset + limit rows, the total a count beside it: nothing is sorted whole.
    """
    offset = max(0, offset)
    found = rows.orderBy(*_orders(by, descending, tie))
    found = found.offset(offset) if offset else found
    found = found if limit is None else found.limit(max(0, limit))
    total = rows.agg(F.count("*").alias("total"))
    last = F.lit(False) if limit is None else F.col("total") > offset + max(0, limit)
    return found.join(F.broadcast(total)).withColumn("has_more", last)


def page_by(rows: DataFrame, key: str, by: str, tie: str, *, descending: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    """The page of every value of key, as page(): place counts from 1 over the whole order."""
    keyed = Window.partitionBy(key)
    place = F.row_number().over(keyed.orderBy(*_orders(by, descending, tie)))
    marked = rows.withColumn("place", place).withColumn("total", F.count("*").over(keyed))
    return marked.where((F.col("place") > max(0, offset)) & (F.col("place") <= max(0, offset) + limit)).withColumn("has_more", F.col("total") > max(0, offset) + limit)
