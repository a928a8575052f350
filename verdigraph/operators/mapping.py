"""Matching of characterisation factors and flows: a cascade of equi-joins, best match first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Strategies in order of trust.
STRATEGIES = ("uuid", "cas", "name", "synonym")


def compartment_rank(category: Column, sub: Column, medium: Column, wanted: Column) -> Column:
    """0: medium and sub agree, 1: medium agrees, 2: neither. A name agrees when equal or part of the category."""
    low = F.lower(category)
    same = F.coalesce(F.contains(low, F.lower(medium)), F.lit(False))
    inner = F.coalesce((F.trim(wanted) == "") | (F.lower(sub) == F.lower(wanted)) | F.contains(low, F.lower(wanted)), F.lit(True))
    return F.when(same & inner, 0).when(same, 1).otherwise(2)


def match_factors(factors: DataFrame, flows: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(method, cf_id, flow_id, strategy) of every factor; flow_id is null where nothing matches.

    factors (method, cf_id, flow_ref, cf_name, cas, medium, sub), flows (flow_id, name, category,
    sub, cas, kind), synonyms (norm_name, gid). By id any flow matches, by CAS, name and synonym
    only a biosphere flow; among several the compartment decides, then the flow's id.
    """
    bio = flows.where("kind = 'biosphere'").select("flow_id", T.normalize_name(F.col("name")).alias("key"), "category", F.col("sub").alias("flow_sub"), T.cas_first(F.col("cas")).alias("flow_cas"))
    own = factors.select("method", "cf_id", "flow_ref", T.normalize_name(F.col("cf_name")).alias("cf_key"), T.cas_first(F.col("cas")).alias("cf_cas"), "medium", "sub")
    hits = [own.join(flows.select("flow_id", "category", F.col("sub").alias("flow_sub")), F.col("flow_ref") == F.col("flow_id")).withColumn("rank", F.lit(0))]
    hits.append(own.join(bio, F.col("cf_cas") == F.col("flow_cas")).withColumn("rank", F.lit(1)))
    hits.append(own.join(bio, F.col("cf_key") == F.col("key")).withColumn("rank", F.lit(2)))
    if synonyms is not None:
        a, b = synonyms.selectExpr("norm_name as cf_key", "gid"), synonyms.selectExpr("norm_name as key", "gid")
        hits.append(own.join(a, "cf_key").join(b, "gid").join(bio, "key").withColumn("rank", F.lit(3)))
    columns = ["method", "cf_id", "flow_id", "rank", "category", "flow_sub", "medium", "sub"]
    found = hits[0].select(columns)
    for h in hits[1:]:
        found = found.unionByName(h.select(columns))
    place = compartment_rank(F.col("category"), F.col("flow_sub"), F.col("medium"), F.col("sub"))
    best = found.groupBy("method", "cf_id").agg(F.min(F.struct("rank", place.alias("place"), "flow_id")).alias("best"))
    strategy = F.element_at(F.array(*map(F.lit, STRATEGIES)), F.col("best.rank") + 1)
    return own.select("method", "cf_id").join(best, ["method", "cf_id"], "left").select("method", "cf_id", "best.flow_id", F.when(F.col("best").isNotNull(), strategy).alias("strategy"))


def statistics(matches: DataFrame) -> DataFrame:
    """(method, factors, matched, flows, coverage in percent, and a count for each strategy)."""
    counts = [F.count_if(F.col("strategy") == s).alias(f"by_{s}") for s in STRATEGIES]
    found = matches.groupBy("method").agg(F.count("*").alias("factors"), F.count("flow_id").alias("matched"), F.count_distinct("flow_id").alias("flows"), *counts)
    return found.withColumn("coverage", F.col("matched") / F.col("factors") * 100)


def unmatched(matches: DataFrame) -> DataFrame:
    return matches.where("flow_id is null").select("method", "cf_id")


def uncharacterised(flows: DataFrame, matches: DataFrame) -> DataFrame:
    """Biosphere flows that no factor reaches."""
    return flows.where("kind = 'biosphere'").join(matches.select("flow_id").where("flow_id is not null").distinct(), "flow_id", "left_anti").select("flow_id", "name")


def merged_flows(flows: DataFrame) -> DataFrame:
    """One row for each flow id of several databases (flow_id, db, name, category, synonyms): the first database's, with all synonyms."""
    first = Window.partitionBy("flow_id").orderBy("db")
    rows = flows.withColumn("n", F.row_number().over(first)).withColumn("all", F.array_sort(F.array_distinct(F.flatten(F.collect_set("synonyms").over(Window.partitionBy("flow_id"))))))
    return rows.where("n = 1").select("flow_id", "name", "category", F.col("all").alias("synonyms"))
