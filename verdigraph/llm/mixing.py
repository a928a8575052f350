"""Operator 7 [native]: mixing sources to target weights by systematic sampling.

All of a source's documents have the same expected number of copies, target / size of the
source. Documents are ordered by size within the source, the expected copies are summed up
along that order from one offset drawn for the source, and a document is emitted once for
each whole number that its stretch crosses. In order of size the words taken stay near the
target, as a document that is passed over has a neighbour of about its size.

Sources are ordered among themselves, and their targets settled, in windows over one row for
each source: sources are as many as corpora are (dozens to some hundred thousand), not as
documents. The table of groups that is broadcast has SALTS * (size classes) rows for each
source at most, about 200 classes for sizes up to 2^25 words; Spark broadcasts it only where
it is below the session's threshold.

The order is (size class, salt, size, doc_id): a source of any size is dealt out over
(classes x salts) groups, whose counts are summed up before anything is ranked, so that no
task holds a source.

Defined results: a null text has size 0; a null source is a source, the last one; equal
doc_ids are ranked by text length, and each row is a document; without words every target
is 0; other columns take no part and go along with emitted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column, unused

SALTS = 64
#: No document is taken more often than this, and no source's target is more than this times its size.
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    """Eight classes for each doubling of the size, by whole numbers."""
    digits = F.length(F.bin(size))
    return (digits * 8 + F.floor(size * 8 / F.pow(F.lit(2.0), digits - 1)) - 8).cast("int")


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1)."""
    return _hex(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))), 7) / F.lit(float(16**7))


def _targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    The targets fill up the sources by weight to one level, but a source no higher than MOST
    times its size: with the sources by the level at which they are full, the level is the
    greatest of (what is left when all before are full) / (weights from here on).
    There is one row for each source here.
    """
    nulls_last = F.col("source").asc_nulls_last()
    weighed = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(nulls_last)) - 1) % 3 + 1).cast("long"))
    full = weighed.withColumn("full", F.col("source_size") * MOST)
    order = Window.orderBy(F.col("full") / F.col("weight"), nulls_last)
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - before
    level = left.cast("double") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    top = F.max("level").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("full").cast("double"), F.col("weight").cast("double") * F.col("top"))
    return full.withColumn("level", level).withColumn("top", top).select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, seed: int = 7, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, copies of every row of docs (doc_id, text, source).

    With carry, the columns of docs come first, under their own names, and the five others
    are one struct, of the first name like "vg_mix" that docs doesn't have.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = word_count(F.col("text"))
    own = [column(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)] if carry else []
    salt = (_hex(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4) % SALTS).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), salt.alias("salt"), F.length("text").alias("n"), *own)
    rows = rows.withColumn("class", _size_class(F.col("size")))
    groups = scratch.save(rows.groupBy("source", "class", "salt").agg(F.count("*").alias("docs"), F.sum("size").alias("words")), "groups")
    targets = _targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")))
    along = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("before", F.coalesce(F.sum("docs").over(along), F.lit(0)))
    starts = starts.alias("g").join(targets.alias("t"), F.expr("g.source <=> t.source")).selectExpr("g.source as g_source", "g.class as g_class", "g.salt as g_salt", "before", "source_size", "target")
    starts = scratch.save(starts, "starts")
    within = Window.partitionBy("source", "class", "salt").orderBy("size", F.col("doc_id").asc_nulls_first(), "n")
    ranked = rows.withColumn("rank", F.row_number().over(within))
    found = ranked.join(starts, F.expr("source <=> g_source and class = g_class and salt = g_salt"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    rank, offset = (F.col("before") + F.col("rank")).cast("double"), _offset(F.col("source"), seed)
    n = F.least(F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset), F.lit(MOST))
    out = [F.col("doc_id"), F.col("size"), F.col("source_size"), F.col("target"), n.cast("long").alias("copies")]
    if carry:
        return found.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)], F.struct(*out).alias(unused(docs, "vg_mix")[0]))
    return found.select(*out)


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix: rows of docs, each as often as it is taken."""
    (name,) = unused(docs, "vg_mix")
    n = column(name)["copies"]
    emitted = copies(docs, seed, carry=True).where(n > 0).withColumn(name, F.explode(F.sequence(F.lit(1), n.cast("int"))))
    return emitted.select(*[column(c) for c in docs.columns])


#: The same in DuckDB, statement for statement.
ORACLE = r"""
with rows as (
  select doc_id, source, length(coalesce(text, '')) as n,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 4))::bigint % 64 as int) as salt
  from documents),
classed as (
  select *, cast(length(bin(size)) * 8 + floor(size * 8 / pow(2.0, length(bin(size)) - 1)) - 8 as int) as class from rows),
sizes as (select source, cast(sum(size) as bigint) as source_size from classed group by source),
weighed as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, source_size * 3 as fullsize from sizes),
levels as (
  select *, cast((select sum(source_size) from sizes) - coalesce(sum(fullsize) over (order by fullsize / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as double)
         / cast(sum(weight) over (order by fullsize / weight, source nulls last rows between current row and unbounded following) as double) as level
  from weighed),
targets as (
  select source, source_size, least(cast(fullsize as double), cast(weight as double) * (select max(level) from levels)) as target from levels),
ranked as (
  select *, cast(row_number() over (partition by source order by class, salt, size, doc_id nulls first, n) as double) as rk from classed),
found as (
  select r.doc_id, r.size, t.source_size, t.target, r.rk,
         case when t.source_size > 0 then t.target / cast(t.source_size as double) else 0.0 end as each,
         cast(('0x' || substr(md5('7:' || coalesce('s' || r.source, 'n')), 1, 7))::bigint as double) / 268435456.0 as u
  from ranked r join targets t on r.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(size * least(floor(rk * each + u) - floor((rk - 1) * each + u), 3) as bigint) as taken
from found
"""
