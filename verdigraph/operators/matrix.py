"""Coefficient tables and solves: everything is keyed by root, so a batch of roots is one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units

SMALLEST = 1e-15


def _norm(total) -> Column:
    """The norm of an activity; total sums a column over the activity's exchanges."""
    tech = F.col("kind") == "technosphere"
    own = tech & (F.col("link") == F.col("act_id")) & (F.col("flow_id") == F.col("act_id")) & F.col("is_input") & ~F.col("is_reference")
    made = total(F.when(tech & F.col("is_reference") & ~F.col("is_input"), F.col("amount")).otherwise(0.0))
    used = total(F.when(own, F.col("amount")).otherwise(0.0))
    taken = total(F.when(tech & F.col("is_reference") & F.col("is_input"), F.abs("amount")).otherwise(0.0))
    net = made - used
    return F.when(net > SMALLEST, net).when(taken > SMALLEST, taken).otherwise(1.0)


def norm_factors(exchanges: DataFrame) -> DataFrame:
    """(act_id, norm): reference outputs less inputs from the activity itself; else reference inputs; else 1."""
    return exchanges.where("kind = 'technosphere'").groupBy("act_id").agg(_norm(F.sum).alias("norm"))


def _normed(exchanges: DataFrame) -> DataFrame:
    """The exchanges with their activity's norm: one shuffle by activity, no second look at the table."""
    act = Window.partitionBy("act_id")
    return exchanges.withColumn("norm", _norm(lambda c: F.sum(c).over(act)))


def technosphere(exchanges: DataFrame, defs: DataFrame | None = None) -> DataFrame:
    """(sup, con, v): inputs positive, other outputs negative, over the consumer's norm; no diagonal.

    With unit definitions, amounts are converted to the unit of the supplier's reference
    product; a pair of units that differ and can't be converted raises an error.
    """
    rows = _normed(exchanges).where("kind = 'technosphere' and not is_reference and link is not null and link != act_id")
    if defs is not None:
        made = exchanges.where("kind = 'technosphere' and is_reference").groupBy(F.col("act_id").alias("link")).agg(F.min_by("unit", "seq").alias("made_unit"))
        rows = units.with_conversion(rows.join(made, "link", "left"), defs, "amount", "unit", "made_unit", "converted")
        same = F.col("made_unit").isNull() | (units.unit_key(F.col("unit")) == units.unit_key(F.col("made_unit")))
        message = F.concat(F.lit("no conversion from "), F.coalesce("unit", F.lit("?")), F.lit(" to "), "made_unit", F.lit(" for "), "act_id")
        rows = rows.withColumn("amount", F.when(same, F.col("amount")).otherwise(F.coalesce("converted", F.raise_error(message).cast("double"))))
    signed = F.when(F.col("is_input"), F.col("amount")).otherwise(-F.col("amount"))
    rows = rows.select(F.col("link").alias("sup"), F.col("act_id").alias("con"), (signed / F.col("norm")).alias("v"))
    return rows.groupBy("sup", "con").agg(F.sum("v").alias("v")).where(F.abs("v") > SMALLEST)


def biosphere(exchanges: DataFrame) -> DataFrame:
    """(flow_id, act_id, v): amounts as given over the activity's norm."""
    rows = _normed(exchanges).where("kind = 'biosphere'").select("flow_id", "act_id", (F.col("amount") / F.col("norm")).alias("v"))
    return rows.groupBy("flow_id", "act_id").agg(F.sum("v").alias("v")).where(F.abs("v") > SMALLEST)


def solve_levels(roots: DataFrame, tech: DataFrame, depth: int, demand: str | None = None) -> DataFrame:
    """(root, act_id, x, depth) of x = d + A x, exact where no chain of suppliers is longer than depth.

    One traversal gives the amounts and the least number of steps. roots (root), or with
    demand, a column of it, roots (root, act_id, demand).
    """
    level = roots.select("root", F.col("root").alias("act_id"), F.lit(1.0).alias("x")) if demand is None else roots.select("root", "act_id", F.col(demand).alias("x"))
    total = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(tech, F.col("con") == F.col("act_id")).groupBy("root", F.col("sup").alias("act_id")).agg(F.sum(F.col("x") * F.col("v")).alias("x"))
        total = total.unionByName(level.withColumn("depth", F.lit(d)))
    return total.groupBy("root", "act_id").agg(F.sum("x").alias("x"), F.min("depth").alias("depth"))


def intensities(seed: DataFrame, tech: DataFrame, depth: int) -> DataFrame:
    """(act_id, key, y): what one unit of each activity takes of each key along all its suppliers, y = w + y A.

    The transposed system: seed (act_id, key, w) holds what an activity takes itself. The
    tables are activities x keys, whatever the number of roots is.
    """
    level = seed.select("act_id", "key", F.col("w").cast("double").alias("y"))
    total = level
    for _ in range(depth):
        level = level.join(tech, F.col("sup") == F.col("act_id")).groupBy(F.col("con").alias("act_id"), "key").agg(F.sum(F.col("y") * F.col("v")).alias("y"))
        total = total.unionByName(level)
    return total.groupBy("act_id", "key").agg(F.sum("y").alias("y"))


#: Coefficients that solve_blocks shares with its tasks, and activities of a dense factorisation, at most.
ENTRIES, DENSE = 20_000_000, 4000


def _sweeps(row: np.ndarray, col: np.ndarray, v: np.ndarray, d: np.ndarray, tolerance: float, most: int) -> np.ndarray:
    x = d
    for _ in range(most):
        new = d + np.bincount(row, v * x[col], len(d))
        moved, x = np.abs(new - x).max(), new
        if moved < tolerance or not np.isfinite(moved):
            break
    return x


def _krylov(row: np.ndarray, col: np.ndarray, v: np.ndarray, d: np.ndarray, tolerance: float, most: int) -> np.ndarray:
    """Stabilised biconjugate gradients for (I - A) x = d."""
    times = lambda y: y - np.bincount(row, v * y[col], len(d))
    x = np.zeros_like(d)
    r = d - times(x)
    first, p = r.copy(), r.copy()
    rho = first @ r
    for _ in range(most):
        if np.abs(r).max() < tolerance:
            break
        ap = times(p)
        alpha = rho / (first @ ap)
        s = r - alpha * ap
        t = times(s)
        omega = (t @ s) / (t @ t) if s.any() else 0.0
        x = x + alpha * p + omega * s
        r = s - omega * t
        new = first @ r
        if not np.isfinite(x).all() or not new or not omega:
            break
        p = r + (new / rho) * (alpha / omega) * (p - omega * ap)
        rho = new
    return x


def solve_blocks(roots: DataFrame, tech: DataFrame, tolerance: float = 1e-12, most: int = 200) -> DataFrame:
    """(root, act_id, x) for any A, cyclic ones included.

    A's coordinates (a database of activities, not the roots; ENTRIES at most, or ValueError)
    are collected once and broadcast; blocks of roots are solved in parallel, by sweeps while
    they contract, else by a Krylov method, else with the inverse, which a task makes once, of
    at most DENSE activities; the residual is checked.
    """
    entries = tech.count()
    if entries > ENTRIES:
        raise ValueError(f"{entries} coefficients: solve_blocks shares {ENTRIES} at most; use solve_levels or intensities")
    coo = tech.select("sup", "con", "v").toPandas()
    names = pd.Index(pd.unique(pd.concat([coo["sup"], coo["con"]]))).sort_values()
    row, col, v, n = names.get_indexer(coo["sup"]), names.get_indexer(coo["con"]), coo["v"].to_numpy(float), len(names)
    order = np.argsort(row, kind="stable")
    shared = roots.sparkSession.sparkContext.broadcast((names, row[order], col[order], v[order]))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, row, col, v = shared.value
        inverse = None
        error = lambda x, d: np.abs(d + np.bincount(row, v * x[col], n) - x).max()
        for batch in batches:
            for root in batch["root"]:
                at = names.get_indexer([root])[0]
                if at < 0:
                    yield pd.DataFrame({"root": [root], "act_id": [root], "x": [1.0]})
                    continue
                d = np.bincount([at], minlength=n).astype(float)
                with np.errstate(all="ignore"):
                    x = _sweeps(row, col, v, d, tolerance, most)
                    if not error(x, d) <= 1e-9:
                        x = _krylov(row, col, v, d, 1e-10, 4 * most)
                if not error(x, d) <= 1e-9 and n <= DENSE:
                    if inverse is None:
                        full = np.eye(n)
                        np.subtract.at(full, (row, col), v)
                        inverse = np.linalg.inv(full)
                    x = inverse[:, at]
                if not error(x, d) <= 1e-6:
                    raise ValueError(f"no solution for {root}: the system is singular")
                some = np.flatnonzero(x)
                yield pd.DataFrame({"root": root, "act_id": names[some], "x": x[some]})

    parts = max(1, int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return roots.select("root").repartition(parts, "root").mapInPandas(solve, "root string, act_id string, x double")


def substitute(tech: DataFrame, changes: DataFrame) -> DataFrame:
    """tech with consumers' suppliers exchanged: changes (con, old, new). Each edited system is solved anew, so changes interact exactly."""
    moved = changes.join(tech, (changes["con"] == tech["con"]) & (changes["old"] == tech["sup"])).select(changes["con"].alias("con"), changes["old"].alias("old"), changes["new"].alias("new"), "v")
    rows = tech.select("sup", "con", "v").unionByName(moved.selectExpr("old as sup", "con", "-v as v")).unionByName(moved.selectExpr("new as sup", "con", "v"))
    return rows.groupBy("sup", "con").agg(F.sum("v").alias("v")).where(F.abs("v") > SMALLEST)


def multiply(coo: DataFrame, x: DataFrame, row: str, col: str) -> DataFrame:
    """(root, row, y) of y = M x for every root."""
    return coo.join(x, coo[col] == x["act_id"]).groupBy("root", row).agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def inventory(bio: DataFrame, scaling: DataFrame) -> DataFrame:
    """(root, flow_id, q)."""
    return bio.join(scaling, "act_id").groupBy("root", "flow_id").agg(F.sum(F.col("v") * F.col("x")).alias("q"))


def link_demands(links: DataFrame, scaling: DataFrame, norms: DataFrame) -> DataFrame:
    """(root, source_db, sup, amount): what links (con, sup, source_db, coefficient) ask of other databases."""
    rows = links.join(scaling, links["con"] == scaling["act_id"]).join(norms.withColumnRenamed("act_id", "n_id"), F.col("con") == F.col("n_id"), "left")
    amount = F.col("coefficient") * F.col("x") / F.coalesce("norm", F.lit(1.0))
    return rows.where("x != 0").groupBy("root", "source_db", "sup").agg(F.sum(amount).alias("amount"))
