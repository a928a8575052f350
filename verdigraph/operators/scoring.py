"""Factors looked up at scoring time, and impacts of many roots by many methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import ScoringSet, score_all
from .mapping import STRATEGIES


def lookup(flows: DataFrame, matches: DataFrame) -> DataFrame:
    """(method, flow_id, cf, level) of flows (flow_id, name, category, sub) among matched factors.

    matches (method, flow_id, cf_name, medium, sub, cf, strategy). Level 1: the flow's id, of
    factors matched by id; 2: name, medium and inner compartment; 3: name and medium. Of several
    factors with a key the better strategy holds, then the greater value.
    """
    name, medium = T.normalize_name(F.col("name")), F.regexp_replace(F.lower(F.split("category", "/")[0]), "^natural resource$", "resource")
    own = flows.select("flow_id", name.alias("key"), F.trim(medium).alias("f_medium"), F.lower(F.coalesce("sub", F.lit(""))).alias("f_sub"))
    ranked = matches.withColumn("rank", F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy")))
    better = F.struct((-F.col("rank")).alias("r"), "cf")
    by_id = matches.where("strategy = 'uuid'").groupBy("method", "flow_id").agg(F.max("cf").alias("cf")).withColumn("level", F.lit(1))
    keyed = ranked.select("method", T.normalize_name(F.col("cf_name")).alias("key"), F.regexp_replace(F.lower("medium"), "^natural resource$", "resource").alias("f_medium"), F.lower(F.coalesce("sub", F.lit(""))).alias("f_sub"), "rank", "cf")
    full = keyed.groupBy("method", "key", "f_medium", "f_sub").agg(F.max_by("cf", better).alias("cf"))
    wide = keyed.groupBy("method", "key", "f_medium").agg(F.max_by("cf", better).alias("cf"))
    found = by_id.select("method", "flow_id", "cf", "level")
    found = found.unionByName(own.join(full, ["key", "f_medium", "f_sub"]).select("method", "flow_id", "cf", F.lit(2).alias("level")))
    found = found.unionByName(own.join(wide, ["key", "f_medium"]).select("method", "flow_id", "cf", F.lit(3).alias("level")))
    best = found.join(own.select("flow_id"), "flow_id").groupBy("method", "flow_id").agg(F.min_by(F.struct("cf", "level"), "level").alias("b"))
    return best.select("method", "flow_id", "b.cf", "b.level")


def by_flow(flows: DataFrame, matches: DataFrame) -> DataFrame:
    """Every biosphere flow with its factor by method, null where it has none; the last factor by id holds."""
    last = matches.where("flow_id is not null").groupBy("flow_id", "method").agg(F.max_by("cf", "cf_id").alias("cf"))
    return flows.where("kind = 'biosphere'").select("flow_id", "name").join(last, "flow_id", "left")


def batch(asked: DataFrame, roots: DataFrame, scores: DataFrame) -> DataFrame:
    """(asked, method, score, outcome) of asked ids: found with its scores, not_found, or invalid where there is no id."""
    rows = asked.join(roots.select(F.col("root").alias("asked"), F.lit(True).alias("there")), "asked", "left")
    outcome = F.when(F.coalesce(F.trim("asked"), F.lit("")) == "", "invalid").when(F.col("there"), "found").otherwise("not_found")
    return rows.withColumn("outcome", outcome).join(scores.withColumnRenamed("root", "asked"), "asked", "left").select("asked", "method", "score", "outcome")


def sets(scores: DataFrame, chosen: list[ScoringSet]) -> DataFrame:
    """(root, set_name, name, kind, value) of scores (root, method, score): scores and indicators of the scoring sets.

    A root's scores are one row for each method, a handful; sets that can't be scored are left out.
    """

    def rows(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for root, raw in zip(batch["root"], batch["raw"], strict=True):
                for name, found in score_all(chosen, dict(raw)).items():
                    out += [(root, name, n, "score", v) for n, v in found.scores.items()] + [(root, name, n, "indicator", v) for n, v in found.indicators.items()]
            yield pd.DataFrame(out, columns=["root", "set_name", "name", "kind", "value"])

    raw = scores.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("method", "score"))).alias("raw"))
    return raw.mapInPandas(rows, "root string, set_name string, name string, kind string, value double")


def hotspots(contributions: DataFrame, limit: int = 20) -> DataFrame:
    """(root, method, act_id, contribution, share in percent, place): the greatest contributions of each root and method."""
    keyed = Window.partitionBy("root", "method")
    total = F.sum("contribution").over(keyed)
    rows = contributions.withColumn("share", F.when(total != 0, F.col("contribution") / total * 100).otherwise(0.0))
    place = F.row_number().over(keyed.orderBy(F.abs("contribution").desc(), "act_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def unknown_flows(inventory: DataFrame, flows: DataFrame) -> DataFrame:
    """(root, flow_id): inventory flows without metadata."""
    return inventory.where("q != 0").join(flows.select("flow_id"), "flow_id", "left_anti").select("root", "flow_id")
