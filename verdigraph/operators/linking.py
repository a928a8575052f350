"""Suppliers for exchanges: within a database by tiers of keys, across databases by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Points of a name, and of a location that is the same, around, everywhere, unrelated, or narrower; what a link needs.
NAME, SAME, AROUND, GLOBAL, OTHER, NARROWER, ENOUGH = 50, 30, 20, 10, 5, 0, 55
# Locations that stand for everywhere.
EVERYWHERE = ("GLO", "RoW", "Unspecified")


def location_score(wanted: Column, offered: Column, wanted_parents: Column, offered_parents: Column) -> Column:
    """How well a supplier's location serves the wanted one; parents are arrays of codes."""
    return (
        F.when(wanted == offered, SAME)
        .when(F.coalesce(F.array_contains(wanted_parents, offered), F.lit(False)), AROUND)
        .when(offered.isin(*EVERYWHERE), GLOBAL)
        .when(F.coalesce(F.array_contains(offered_parents, wanted), F.lit(False)) | wanted.isin(*EVERYWHERE), NARROWER)
        .otherwise(OTHER)
    )


def supplier_keys(suppliers: DataFrame) -> DataFrame:
    """(key, tier, and the supplier's columns): its name in full (tier 0) and its shorter forms (tier 1)."""
    keyed = suppliers.withColumn("vg_keys", F.concat(F.array(F.struct(T.link_key(F.col("product")).alias("key"), F.lit(0).alias("tier"))), F.transform(T.product_prefixes(F.col("product")), lambda p: F.struct(T.link_key(p).alias("key"), F.lit(1).alias("tier")))))
    return keyed.select("*", F.explode("vg_keys").alias("vg_k")).select("*", "vg_k.key", "vg_k.tier").drop("vg_keys", "vg_k").dropDuplicates(["key", "act_id"])


def cross_links(asked: DataFrame, suppliers: DataFrame, dims: DataFrame, geographies: DataFrame) -> DataFrame:
    """(con, seq, supplier, source_db, score, blocker) of every asked input.

    asked (con, seq, product, unit, location), suppliers (act_id, db, product, unit, location),
    dims (unit, dim), geographies (code, parents). Names match in full before in their shorter
    forms; units must be of one dimension; the best score wins, on a tie the last by id.
    Blockers: no_name, unit, location.
    """
    forms = asked.withColumn("vg_forms", F.concat(F.array(T.link_key(F.col("product"))), F.transform(T.product_prefixes(F.col("product")), T.link_key)))
    forms = forms.select("con", "seq", F.col("unit").alias("a_unit"), F.col("location").alias("a_loc"), F.posexplode("vg_forms").alias("form", "key"))
    keyed = supplier_keys(suppliers).select("key", "tier", "act_id", "db", F.col("unit").alias("s_unit"), F.col("location").alias("s_loc"))
    pairs = forms.join(keyed, "key")
    first = pairs.groupBy("con", "seq").agg(F.min(F.struct("form", "tier")).alias("f"))
    pairs = pairs.join(first, ["con", "seq"]).where("form = f.form")
    a, b = dims.selectExpr("unit as a_unit", "dim as a_dim"), dims.selectExpr("unit as s_unit", "dim as s_dim")
    pairs = pairs.join(a, "a_unit", "left").join(b, "s_unit", "left")
    fits = (F.lower(F.trim("a_unit")) == F.lower(F.trim("s_unit"))) | F.coalesce(F.col("a_dim") == F.col("s_dim"), F.lit(False))
    g, h = geographies.selectExpr("code as a_loc", "parents as a_parents"), geographies.selectExpr("code as s_loc", "parents as s_parents")
    pairs = pairs.join(g, "a_loc", "left").join(h, "s_loc", "left")
    score = F.lit(NAME) + location_score(F.col("a_loc"), F.col("s_loc"), F.col("a_parents"), F.col("s_parents"))
    scored = pairs.withColumn("fits", fits).withColumn("score", score)
    best = scored.groupBy("con", "seq").agg(F.max(F.when(F.col("fits"), F.struct("score", "act_id", "db"))).alias("best"))
    out = asked.select("con", "seq").join(best, ["con", "seq"], "left").join(first.select("con", "seq", F.lit(True).alias("named")), ["con", "seq"], "left")
    linked = F.coalesce(F.col("best.score") >= ENOUGH, F.lit(False))
    blocker = F.when(F.col("named").isNull(), "no_name").when(F.col("best").isNull(), "unit").when(~linked, "location")
    return out.select("con", "seq", F.when(linked, F.col("best.act_id")).alias("supplier"), F.when(linked, F.col("best.db")).alias("source_db"), F.when(linked, F.col("best.score")).alias("score"), blocker.alias("blocker"))


def tiered_links(asked: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(con, seq, supplier, tier): by dataset number and name, else name and location, else name alone; the last supplier of a key holds.

    asked (con, seq, number, name, location), suppliers (act_id, number, name, location).
    """
    s = suppliers.select("act_id", "number", T.link_key(F.col("name")).alias("s_name"), F.trim("location").alias("s_loc"))
    a = asked.select("con", "seq", F.col("number").alias("a_number"), T.link_key(F.col("name")).alias("a_name"), F.trim("location").alias("a_loc"))
    by_number = s.groupBy("number", "s_name").agg(F.max("act_id").alias("by_number"))
    by_place = s.groupBy("s_name", "s_loc").agg(F.max("act_id").alias("by_place"))
    by_name = s.groupBy("s_name").agg(F.max("act_id").alias("by_name"))
    out = a.join(by_number.withColumnRenamed("s_name", "n1"), (F.col("a_number") == F.col("number")) & (F.col("a_name") == F.col("n1")), "left")
    out = out.join(by_place.withColumnRenamed("s_name", "n2"), (F.col("a_name") == F.col("n2")) & (F.col("a_loc") == F.col("s_loc")), "left")
    out = out.join(by_name.withColumnRenamed("s_name", "n3"), F.col("a_name") == F.col("n3"), "left")
    tier = F.when(F.col("by_number").isNotNull(), 1).when(F.col("by_place").isNotNull(), 2).when(F.col("by_name").isNotNull(), 3)
    return out.select("con", "seq", F.coalesce("by_number", "by_place", "by_name").alias("supplier"), tier.alias("tier"))


def completeness(links: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: inputs, resolved, percent (100 without inputs)."""
    n = asked.agg(F.count("*").alias("inputs"))
    done = links.where("supplier is not null").agg(F.count("*").alias("resolved"))
    return n.join(F.broadcast(done)).withColumn("percent", F.when(F.col("inputs") > 0, F.col("resolved") / F.col("inputs") * 100).otherwise(100.0))
