"""Inventories over linked databases: each is solved on its own, and links carry demands to the next.

A database holds tech (sup, con, v), bio (flow_id, act_id, v) and links (con, source_db, sup,
v) to suppliers in other databases, all per unit of the consumer's reference product.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units
from . import matrix

#: Steps from database to database, at most.
STEPS = 10


@dataclass(frozen=True)
class Database:
    """depth: its longest chain of suppliers."""

    tech: DataFrame
    bio: DataFrame
    links: DataFrame
    depth: int


def demand_of(asked: DataFrame, references: DataFrame, defs: DataFrame) -> DataFrame:
    """(root, act_id, amount) of asked (root, sup, amount, unit) in the units of the suppliers' references (act_id, unit).

    A pair of units without conversion raises an error; suppliers that aren't there drop out.
    """
    made = references.select("act_id", F.col("unit").alias("made_unit"))
    rows = units.with_conversion(asked.join(made, F.col("sup") == F.col("act_id")), defs, "amount", "unit", "made_unit", "converted")
    same = units.unit_key(F.col("unit")) == units.unit_key(F.col("made_unit"))
    message = F.concat(F.lit("no conversion from "), "unit", F.lit(" to "), "made_unit")
    amount = F.when(same, F.col("amount")).otherwise(F.coalesce("converted", F.raise_error(message).cast("double")))
    return rows.groupBy("root", "act_id").agg(F.sum(amount).alias("amount"))


def reachable(databases: dict[str, Database], start: str) -> set[str]:
    """The databases whose activities a root in start may need; one row for each database and link target is collected."""
    targets = {name: {r.source_db for r in db.links.select("source_db").distinct().collect()} for name, db in databases.items()}
    found, new = set(), {start}
    while new:
        found |= new
        new = {t for n in new for t in targets.get(n, ())} - found
    return found


def solve(databases: dict[str, Database], start: str, demand: DataFrame) -> DataFrame:
    """(root, db, act_id, x) of demand (root, act_id, amount) on start, in all databases.

    Demands that meet in one database after as many steps are solved in one plan; a database
    that isn't loaded gives nothing.
    """
    order = _steps(databases, start)
    pending, out = {start: demand.select("root", "act_id", "amount")}, None
    for _ in range(STEPS + 1):
        asked: dict[str, DataFrame] = {}
        for name, rows in pending.items():
            if name not in databases:
                continue
            db = databases[name]
            rows = rows.groupBy("root", "act_id").agg(F.sum("amount").alias("amount"))
            scaling = matrix.solve_levels(rows, db.tech, db.depth, "amount")
            found = scaling.select("root", F.lit(name).alias("db"), "act_id", "x")
            out = found if out is None else out.unionByName(found)
            for target in order[name]:
                links = db.links.where(F.col("source_db") == target)
                more = links.join(scaling.where("x != 0"), F.col("con") == F.col("act_id")).groupBy("root", "sup").agg(F.sum(F.col("v") * F.col("x")).alias("amount"))
                more = more.select("root", F.col("sup").alias("act_id"), "amount")
                asked[target] = more if target not in asked else asked[target].unionByName(more)
        pending = asked
        if not pending:
            break
    return out.groupBy("root", "db", "act_id").agg(F.sum("x").alias("x"))


def _steps(databases: dict[str, Database], start: str) -> dict[str, list[str]]:
    """Link targets of each database that start reaches."""
    names = reachable(databases, start)
    return {n: sorted(r.source_db for r in databases[n].links.select("source_db").distinct().collect()) for n in names if n in databases}


def inventory(databases: dict[str, Database], scaling: DataFrame) -> DataFrame:
    """(root, flow_id, q): local inventories and those of all dependencies, summed up."""
    out = None
    for name, db in databases.items():
        part = matrix.inventory(db.bio, scaling.where(F.col("db") == name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("root", "flow_id").agg(F.sum("q").alias("q"))


def rewire(databases: dict[str, Database], start: str, changes: DataFrame) -> dict[str, Database]:
    """The databases with consumers' suppliers exchanged: changes (con_db, con, old_db, old, new_db, new).

    Coefficients within a database and links between databases are one table of edges here, so
    that a supplier may move from either to either; a consumer's database must be reachable.
    """
    known = reachable(databases, start)
    asked = {r.con_db for r in changes.select("con_db").distinct().collect()}
    if lost := sorted(asked - (known & set(databases))):
        raise ValueError(f"substitutions in databases that {start} does not reach: {', '.join(lost)}")
    edges = None
    for name, db in databases.items():
        own = db.tech.select(F.lit(name).alias("con_db"), "con", F.lit(name).alias("sup_db"), "sup", "v")
        own = own.unionByName(db.links.select(F.lit(name).alias("con_db"), "con", F.col("source_db").alias("sup_db"), "sup", "v"))
        edges = own if edges is None else edges.unionByName(own)
    moved = changes.selectExpr("con_db", "con", "old_db as sup_db", "old as sup", "new_db", "new").dropDuplicates(["con_db", "con", "sup_db", "sup"])
    joined = edges.join(moved, ["con_db", "con", "sup_db", "sup"], "left")
    edges = joined.select("con_db", "con", F.coalesce("new_db", "sup_db").alias("sup_db"), F.coalesce("new", "sup").alias("sup"), "v")
    edges = edges.groupBy("con_db", "con", "sup_db", "sup").agg(F.sum("v").alias("v")).where(F.abs("v") > matrix.SMALLEST)
    out = {}
    for name, db in databases.items():
        own = edges.where(F.col("con_db") == name)
        out[name] = replace(db, tech=own.where(F.col("sup_db") == name).select("sup", "con", "v"), links=own.where(F.col("sup_db") != name).select("con", F.col("sup_db").alias("source_db"), "sup", "v"))
    return out


def redirect(edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """edges (con_db, con, sup_db, sup, v) with all suppliers of the consumers of a rule (condition, new_db, new) exchanged for one.

    The first rule whose condition holds counts. As rewire with a change for each of these edges, without a
    table of them: edges are summed by what they are dealt by, not joined.
    """
    to_db, to = F.col("sup_db"), F.col("sup")
    for condition, new_db, new in reversed(rules):
        to_db, to = F.when(F.expr(condition), F.lit(new_db)).otherwise(to_db), F.when(F.expr(condition), F.lit(new)).otherwise(to)
    moved = edges.select("con_db", "con", to_db.alias("sup_db"), to.alias("sup"), "v")
    return moved.groupBy("con_db", "con", "sup_db", "sup").agg(F.sum("v").alias("v")).where(F.abs("v") > matrix.SMALLEST)
