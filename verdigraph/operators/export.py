"""Matrix export: four semicolon tables, as DataFrames that Spark's writer puts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNCERTAINTY = ("uncertainty type", "varianceWithPedigreeUncertainty", "minValue", "mostLikelyValue", "maxValue")


def _empty(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in UNCERTAINTY})


def indexes(activities: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The activities' and the flows' numbers, from 0 in order of id: one ordered pass over what a database has of either."""
    a = activities.select((F.row_number().over(Window.orderBy("act_id")) - 1).alias("index"), "act_id", "name", "location", "unit")
    f = flows.select((F.row_number().over(Window.orderBy("flow_id")) - 1).alias("index"), "flow_id", "name", "category", "unit")
    return a, f


def technosphere(activity_index: DataFrame, tech: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows (row, column, coefficient, uncertainty) of I - A; the diagonal is -1 where the reference amount (act_id, amount) is negative."""
    i = activity_index.selectExpr("index as row", "act_id as sup")
    j = activity_index.selectExpr("index as column", "act_id as con")
    off = tech.join(i, "sup").join(j, "con").select("row", "column", (-F.col("v")).alias("coefficient"))
    sign = F.when(F.coalesce("amount", F.lit(1.0)) < 0, -1.0).otherwise(1.0)
    diagonal = activity_index.join(reference, "act_id", "left").select(F.col("index").alias("row"), F.col("index").alias("column"), sign.alias("coefficient"))
    return _empty(diagonal.unionByName(off))


def biosphere(activity_index: DataFrame, flow_index: DataFrame, bio: DataFrame) -> DataFrame:
    i = flow_index.selectExpr("index as row", "flow_id")
    j = activity_index.selectExpr("index as column", "act_id")
    return _empty(bio.join(i, "flow_id").join(j, "act_id").select("row", "column", F.col("v").alias("coefficient")))


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", ";").option("header", "true").option("emptyValue", "").csv(path)


def debug_matrices(scaling: DataFrame, bio: DataFrame, activities: DataFrame, flows: DataFrame, flow: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Supply (root, act_id, name, location, x), and contributions (root, flow_id, flow_name, act_id, v, x, contribution) of flows whose name has flow in it."""
    supply = scaling.where("x != 0").join(activities.select("act_id", "name", "location"), "act_id", "left").select("root", "act_id", "name", "location", "x")
    named = flows.select("flow_id", F.col("name").alias("flow_name"))
    named = named.where(F.contains(F.lower("flow_name"), F.lit(flow.lower()))) if flow else named
    parts = bio.join(named, "flow_id").join(scaling.where("x != 0").select("root", "act_id", "x"), "act_id")
    return supply, parts.select("root", "flow_id", "flow_name", "act_id", "v", "x", (F.col("v") * F.col("x")).alias("contribution"))
