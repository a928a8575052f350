"""Point queries: process ids, activity and flow details, structured filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import aggregate

_ID = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def process_id(act: Column, prod: Column) -> Column:
    """The text of a process: act_prod."""
    return F.concat_ws("_", act, prod)


def qualified(db: Column, act: Column) -> Column:
    """A reference to another database's process: db::act."""
    return F.concat_ws("::", db, act)


def resolve(asked: DataFrame, processes: DataFrame) -> DataFrame:
    """(asked, act_id, prod_id, outcome) of asked (asked) among processes (act_id, prod_id).

    "act_prod" names a process; a bare activity its last product. Outcomes: found, invalid (a
    well-formed pair that isn't there, or no id at all), not_found (an unknown activity).
    """
    last = processes.groupBy("act_id").agg(F.max("prod_id").alias("last"))
    parts = asked.select("asked", F.split("asked", "_").alias("p")).select("asked", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"), F.size("p").alias("n"))
    pairs = processes.selectExpr("act_id as pair_act", "prod_id as pair_prod")
    rows = parts.join(pairs, (F.col("a") == F.col("pair_act")) & (F.col("b") == F.col("pair_prod")) & (F.col("n") == 2), "left")
    rows = rows.join(last, (F.col("a") == F.col("act_id")) & (F.col("n") == 1), "left")
    outcome = F.when(F.col("pair_act").isNotNull() | F.col("last").isNotNull(), "found").when((F.col("n") == 1) & (F.col("a") != ""), "not_found").otherwise("invalid")
    return rows.select("asked", F.coalesce("pair_act", "act_id").alias("act_id"), F.coalesce("pair_prod", "last").alias("prod_id"), outcome.alias("outcome"))


def flow_summaries(exchanges: DataFrame, flows: DataFrame) -> DataFrame:
    """(act_id, flow_id, name, unit, uses, role): one row for each flow of an activity; the role that ranks first of reference, input, output."""
    role = F.when(F.col("is_reference"), 0).when(F.col("is_input"), 1).otherwise(2)
    found = exchanges.groupBy("act_id", "flow_id").agg(F.count("*").alias("uses"), F.min(role).alias("r"))
    named = found.join(flows.select("flow_id", "name", "unit"), "flow_id")
    return named.select("act_id", "flow_id", "name", "unit", "uses", F.element_at(F.array(*map(F.lit, ("reference", "input", "output"))), F.col("r") + 1).alias("role"))


def products(exchanges: DataFrame) -> DataFrame:
    """(act_id, product, amount, unit): every reference output of an activity."""
    return exchanges.where("kind = 'technosphere' and is_reference and not is_input").select("act_id", F.col("flow_id").alias("product"), "amount", "unit")


def flow_details(flows: DataFrame, exchanges: DataFrame) -> DataFrame:
    """flows with uses: in how many exchanges each is."""
    return flows.join(exchanges.groupBy("flow_id").agg(F.count("*").alias("uses")), "flow_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def details(exchanges: DataFrame, activities: DataFrame) -> DataFrame:
    """Exchanges with the activity that supplies them: by link, else by the product's activity.

    (act_id, seq, kind, flow_id, amount, unit, is_input, is_reference, target_id, target_name, target_location)
    """
    made = exchanges.where("kind = 'technosphere' and is_reference and not is_input").groupBy("flow_id").agg(F.max("act_id").alias("maker"))
    rows = exchanges.join(made, "flow_id", "left").withColumn("target_id", F.when((F.col("kind") == "technosphere") & F.col("is_input"), F.coalesce("link", "maker")))
    about = activities.select(F.col("act_id").alias("target_id"), F.col("name").alias("target_name"), F.col("location").alias("target_location"))
    return rows.join(about, "target_id", "left").select("act_id", "seq", "kind", "flow_id", "amount", "unit", "is_input", "is_reference", "target_id", "target_name", "target_location")


def counts(exchanges: DataFrame) -> DataFrame:
    """(act_id, inputs, outputs, references, emissions): an activity's exchanges by kind."""
    tech = F.col("kind") == "technosphere"
    return exchanges.groupBy("act_id").agg(
        F.count_if(tech & F.col("is_input")).alias("inputs"), F.count_if(tech & ~F.col("is_input")).alias("outputs"), F.count_if(F.col("is_reference")).alias("references"), F.count_if(~tech).alias("emissions")
    )


def exact_name(column: Column, name: str) -> Column:
    """Equal but for case."""
    return F.lower(F.upper(column)) == F.lower(F.upper(F.lit(name)))


def structured(rows: DataFrame, *, name: str | None = None, location: str | None = None, product: str | None = None, exact: bool = False, classes: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """Activities (name, location, product, classes) by words of name, place, words of product and classes; exact: name and place in full."""
    if name:
        rows = rows.where(exact_name(F.col("name"), name) if exact else T.contains_words([F.col("name"), F.col("product")], F.lit(name)))
    if location:
        rows = rows.where(exact_name(F.col("location"), location) if exact else F.contains(F.lower("location"), F.lit(location.lower())))
    if product:
        rows = rows.where(T.contains_words([F.col("product")], F.lit(product)))
    return rows.where(aggregate.match_classes(classes)) if classes else rows


def preset(presets: dict[str, list[tuple[str, str, bool]]], name: str | None) -> list[tuple[str, str, bool]]:
    """A preset's class filters; an unknown one has none."""
    return presets.get(name or "", [])


def exchange_filter(rows: DataFrame, *, kind: str | None = None, flow: str | None = None, is_input: bool | None = None) -> DataFrame:
    """Exchanges with flow names (name) by kind, part of the name, and direction."""
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if flow:
        rows = rows.where(F.contains(F.lower("name"), F.lit(flow.lower())))
    return rows if is_input is None else rows.where(F.col("is_input") == is_input)


def flow_search(flows: DataFrame, query: str | None) -> DataFrame:
    """Flows whose name or a synonym has the query in it; none without a query."""
    if not query or not query.strip():
        return flows.limit(0)
    word = F.lit(query.strip().lower())
    hit = F.contains(F.lower("name"), word)
    if "synonyms" in flows.columns:
        hit = hit | F.exists("synonyms", lambda s: F.contains(F.lower(s), word))
    return flows.where(F.coalesce(hit, F.lit(False)))


def supply_filter(rows: DataFrame, *, name: str | None = None, location: str | None = None, min_quantity: float = 0.0, max_depth: int | None = None) -> DataFrame:
    """Rows of a supply chain by words of name, place, least amount and depth."""
    rows = rows.where(F.abs("quantity") >= min_quantity) if min_quantity else rows
    rows = rows.where(F.col("depth") <= max_depth) if max_depth is not None else rows
    rows = rows.where(T.contains_words([F.col("name")], F.lit(name))) if name else rows
    return rows.where(F.contains(F.lower("location"), F.lit(location.lower()))) if location else rows


def class_values(activities: DataFrame, system: str | None = None, part: str | None = None) -> DataFrame:
    """(system, value, activities): all systems, or one's values with part in them."""
    rows = activities.select(F.explode("classes").alias("system", "value"))
    rows = rows.where(F.col("system") == system) if system else rows
    rows = rows.where(F.contains(F.lower("value"), F.lit(part.lower()))) if part else rows
    return rows.groupBy("system", "value").agg(F.count("*").alias("activities"))


def geographies(activities: DataFrame, known: DataFrame) -> DataFrame:
    """(location, display, parents, activities): the places in use, by known (code, display, parents) their names; else the code."""
    used = activities.groupBy("location").agg(F.count("*").alias("activities"))
    rows = used.join(known.withColumnRenamed("code", "location"), "location", "left")
    return rows.select("location", F.coalesce("display", "location").alias("display"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), "activities")


def reference_amounts(activities: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(name, location, amount, unit): of the last product of the last activity of a name and place."""
    last = products(exchanges).groupBy("act_id").agg(F.max(F.struct("product", "amount", "unit")).alias("p"))
    return activities.select("act_id", "name", "location").join(last, "act_id").groupBy("name", "location").agg(F.max(F.struct("act_id", "p")).alias("m")).select("name", "location", "m.p.amount", "m.p.unit")


def induced(nodes: DataFrame, tech: DataFrame) -> DataFrame:
    """(root, sup, con, v): coefficients whose both ends are a root's nodes (root, act_id)."""
    con = nodes.select("root", F.col("act_id").alias("con"))
    return con.join(tech, "con").join(nodes.select("root", F.col("act_id").alias("sup")), ["root", "sup"], "left_semi").select("root", "sup", "con", "v")


def merge_hits(*found: DataFrame) -> DataFrame:
    """(id, score): results of several searchers, the best score of each id."""
    out = found[0].select("id", "score")
    for f in found[1:]:
        out = out.unionByName(f.select("id", "score"))
    return out.groupBy("id").agg(F.max("score").alias("score"))


def name_hits(rows: DataFrame, query: str) -> DataFrame:
    """(id, score) of rows (id, name, cas): 1.0 for the name or the CAS number in full, 0.9 for its beginning, 0.7 for a part."""
    low, word = F.lower("name"), query.strip().lower()
    score = F.when((low == word) | F.coalesce(T.cas_first(F.col("cas")) == T.cas_first(F.lit(word)), F.lit(False)), 1.0).when(low.startswith(word), 0.9).when(F.contains(low, F.lit(word)), 0.7)
    return rows.withColumn("score", score).where("score is not null").select("id", "score")


def lone_supplier(asked: DataFrame, suppliers: DataFrame, dims: DataFrame) -> DataFrame:
    """(con, seq, supplier): by product id, else by name where exactly one supplier's unit fits.

    asked (con, seq, product_id, name, unit), suppliers (act_id, product_id, name, unit), dims (unit, dim).
    """
    ids = suppliers.groupBy("product_id").agg(F.max("act_id").alias("by_id"))
    s = suppliers.select("act_id", F.lower("name").alias("key"), F.lower(F.trim("unit")).alias("s_unit")).join(dims.selectExpr("unit as s_unit", "dim as s_dim"), "s_unit", "left")
    a = asked.withColumn("key", F.lower("name")).withColumn("a_unit", F.lower(F.trim("unit")))
    kinds = a.select("key", "a_unit").distinct().join(dims.selectExpr("unit as a_unit", "dim as a_dim"), "a_unit", "left")
    fits = (F.col("a_unit") == F.col("s_unit")) | F.coalesce(F.col("a_dim") == F.col("s_dim"), F.lit(False))
    named = kinds.join(s, "key").where(fits).groupBy("key", "a_unit").agg(F.count_distinct("act_id").alias("n"), F.max("act_id").alias("by_name")).where("n = 1")
    return a.join(ids, "product_id", "left").join(named, ["key", "a_unit"], "left").select("con", "seq", F.coalesce("by_id", "by_name").alias("supplier"))


def unlinked(exchanges: DataFrame, samples: int = 3, consumers: int = 10) -> DataFrame:
    """(act_id, missing, examples): the consumers with the most suppliers missing, and some of their products."""
    rows = exchanges.where("kind = 'technosphere' and is_input and link is null").select("act_id", "flow_id").distinct()
    order = Window.partitionBy("act_id").orderBy("flow_id")
    some = rows.withColumn("n", F.row_number().over(order)).groupBy("act_id").agg(F.count("*").alias("missing"), F.array_sort(F.collect_list(F.when(F.col("n") <= samples, F.col("flow_id")))).alias("examples"))
    return some.orderBy(F.col("missing").desc(), "act_id").limit(consumers)
