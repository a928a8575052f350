"""Operator 6 [native]: I-Match fingerprints over randomised lexicons.

The lexicon is the terms whose inverse document frequency over the whole corpus lies in a
band: more than RAREST of the documents have them, and no more than COMMONEST of the
documents or of the groups of like documents (those whose SKETCH least term hashes are equal),
so that one large group of near copies does not push its own words out. As no more than (mean
distinct terms a document) / RAREST terms can be so frequent, the lexicon's size is bounded
whatever the corpus' is; it travels as 2^BITS buckets of whole term hashes, the value of a
scalar subquery over a small table, and only its own terms count as inside.

A text's terms in the lexicon are made distinct and sorted (by hash), and hashed whole and
once for each of the fixed random subsets of the lexicon: FAMILIES families of LEVELS subsets,
each a random half of the one before. Dense subsets tell texts apart that differ in a word;
sparse ones stay equal where much has changed. The likeness of two fingerprints is the share
of equal hashes among the subsets that have terms of either text, a subset of level l weighed
by 2^l, which nears the share of terms in common. A text without terms of the lexicon keeps
all its terms; one of white space only is its own single term; the empty text has none.

Ranges of doc_id, RANGE documents each and 20,000 at most, bring neighbours together; beyond
that many a range grows, and Spark's sort and window of it spill.

Defined results: a null text is empty; null doc_ids come first; rows of equal doc_id are
ordered by text and each is a document; a single document is its own next one; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BITS = 16
RAREST, COMMONEST = 0.0005, 0.2
FAMILIES, LEVELS = 6, 12
#: Very frequent terms whose groups are counted in one pass.
BATCH = 2048
#: Texts whose so many least term hashes are equal count as one for COMMONEST: copies, and most near copies.
SKETCH = 4
#: Documents in a range of doc_ids whose neighbours are found together.
RANGE = 1500

_SPACES = r"[\x20\x09-\x0D]+"


def _terms(text: Column) -> Column:
    """The text's distinct terms, as hashes."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), _SPACES), lambda w: w != ""), lambda w: F.xxhash64(w)))


def _array(values: list[int]) -> str:
    """SQL: these numbers as one folded constant."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)"


def _groups(terms: DataFrame, common: list[int]) -> dict[int, int]:
    """In how many groups of like documents each of these terms is, and (None) how many groups there are.

    Documents carry their common terms as bits, which are joined within a group before and in the shuffle.
    """
    found: dict[int, int] = {}
    for k in range(0, max(1, len(common)), BATCH):
        some = common[k : k + BATCH]
        own = terms.withColumn("at", F.expr(f"transform(array_intersect({_array(some)}, ts), t -> array_position({_array(some)}, t) - 1)") if some else F.expr("array(-1L)"))
        words = range(-(-len(some) // 64))
        bits = [F.expr(f"aggregate(at, 0L, (a, i) -> if(i div 64 = {j}, a | shiftleft(1L, cast(i % 64 as int)), a))").alias(f"w{j}") for j in words]
        groups = own.select("likes", *bits).groupBy("likes").agg(F.count("*").alias("docs"), *[F.bit_or(f"w{j}").alias(f"w{j}") for j in words])
        totals = groups.agg(F.count("*").alias("n"), *[F.sum(F.expr(f"cast(shiftrightunsigned(w{i // 64}, {i % 64}) & 1 as long)")).alias(f"t{i}") for i in range(len(some))]).first()
        found[None] = totals.n
        found.update({t: totals[f"t{i}"] or 0 for i, t in enumerate(some)})
    return found


def _lexicon(rows: DataFrame, scratch: Scratch) -> Column:
    """The band's terms as one value: an array of 2^BITS buckets, a term in the bucket of its low bits.

    Terms are counted over all documents, those that are too frequent over the groups of like
    documents as well: no more than (mean distinct terms a document) / COMMONEST. The value is a
    scalar subquery over a table in the shared folder, so that no plan's text holds it.
    """
    n = rows.count()
    terms = rows.select(F.array_sort(_terms(F.col("text"))).alias("ts"))
    df = terms.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    df = scratch.save(df.where(F.col("df") > RAREST * n), "terms")
    common = [r.t for r in df.where(F.col("df") > max(COMMONEST * n, 2)).collect()]
    if common:
        groups = _groups(terms.select("ts", F.xxhash64(F.slice("ts", 1, SKETCH)).alias("likes")), sorted(common))
        common = [t for t in common if groups[t] > COMMONEST * groups[None]]
    band = df.select("t")
    if common:
        band = band.where(~F.array_contains(F.expr(_array(common)), F.col("t")))
    held = band.groupBy(F.col("t").bitwiseAND(F.lit(2**BITS - 1)).alias("id")).agg(F.collect_list("t").alias("ts"))
    every = rows.sparkSession.range(0, 2**BITS, 1, 1).join(held, "id", "left")
    every = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("ts", F.array().cast("array<bigint>")).alias("ts")))).alias("all"))
    return every.select(F.col("all.ts")).scalar()


def _kept(text: Column, lexicon: Column) -> Column:
    """The text's sorted distinct terms in the lexicon, an array of buckets; all its terms if it has none there, the whole text if it has no terms."""
    inside = lambda h: F.array_contains(F.get(lexicon, h.bitwiseAND(F.lit(2**BITS - 1)).cast("int")), h)
    own = F.transform(F.array(F.array_sort(_terms(text))), lambda ts: F.when((F.size(ts) > 0) | (text == ""), ts).otherwise(F.array(F.xxhash64(text))))[0]
    return F.transform(F.array(own), lambda ts: F.transform(F.array(F.filter(ts, inside)), lambda k: F.when(F.size(k) > 0, k).otherwise(ts))[0])[0]


def _patterns() -> list[int]:
    """One for each family of subsets: its subset of level l has the terms whose l low bits are the pattern's."""
    bits = random.Random(6).getrandbits
    return [bits(63) for _ in range(FAMILIES)]


def _hashes(kept: str) -> str:
    """SQL: the hash of all kept terms, then each family's by level; 0 for a subset without any of them."""
    hashed = "if(size(r) = 0, 0L, xxhash64(r))"
    half = "filter(s.r, h -> shiftrightunsigned(h ^ c, l - 1) & 1 = 0)"
    step = f"transform(array({half}), r -> named_struct('r', r, 'f', array_append(s.f, {hashed})))[0]"
    family = f"aggregate(sequence(1, {LEVELS}), named_struct('r', k, 'f', cast(array() as array<bigint>)), (s, l) -> {step}, s -> s.f)"
    whole = "transform(array(k), r -> " + hashed + ")"
    return f"transform(array({kept}), k -> concat({whole}, flatten(transform({_array(_patterns())}, c -> {family}))))[0]"


def likeness(a: str, b: str) -> str:
    """SQL: the weighed share of equal hashes among those that aren't 0 in both; 1 where all are."""
    level = f"shiftleft(1L, if(i = 0, 0, (i - 1) % {LEVELS} + 1))"
    total = f"aggregate(zip_with(transform({a}, (x, i) -> named_struct('x', x, 'w', {level})), {b}, (p, y) -> named_struct('w', if(p.x = 0 and y = 0, 0L, p.w), 'e', if(p.x = y and y != 0, p.w, 0L))), named_struct('w', 0L, 'e', 0L), (s, p) -> named_struct('w', s.w + p.w, 'e', s.e + p.e))"
    return f"transform(array({total}), s -> if(s.w = 0, 1D, cast(s.e as double) / cast(s.w as double)))[0]"


def _with_next(rows: DataFrame, lexicon: Column, scratch: Scratch) -> DataFrame:
    """rows (doc_id, text) with fp, its hashes, and next_text and next_fp of the row that follows by (doc_id, text).

    Ranges of doc_id are dealt out; each gets the first row of the range after it as well, and
    the last one the very first row. Ranges are cut at quantiles, so they hold like numbers of
    rows; where one doc_id is repeated endlessly its rows share a range.
    """
    n = rows.count()
    parts = min(20000, max(1, n // RANGE))
    cuts = []
    if parts > 1:
        cuts = sorted(set(rows.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or []))
    part = F.lit(1)
    if cuts:
        part = F.expr(_search(_array(cuts), len(cuts))) + 1
    dealt = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(part).cast("int"))
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first_id"))
    before = F.lag("part").over(Window.orderBy("part"))
    last = F.max("part").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = scratch.save(firsts.select("part", "first_id", F.coalesce(before, last).alias("into"), before.isNull().alias("wraps")), "firsts")
    guests = dealt.alias("d").join(firsts.alias("f"), F.expr("d.part = f.part and d.doc_id <=> f.first_id"))
    guests = guests.selectExpr("d.doc_id as doc_id", "d.text as text", "f.into as part", "if(f.wraps, 2, 1) as turn")
    guests = guests.withColumn("rank", F.row_number().over(Window.partitionBy("part", "turn").orderBy("text"))).where("rank = 1").drop("rank")
    both = dealt.select("doc_id", "text", "part", F.lit(0).alias("turn")).unionByName(guests)
    both = both.withColumn("lexicon", lexicon).withColumn("kept", _kept(F.col("text"), F.col("lexicon"))).drop("lexicon").withColumn("fp", F.expr(_hashes("kept"))).drop("kept")
    within = Window.partitionBy("part").orderBy("turn", F.col("doc_id").asc_nulls_first(), "text")
    both = both.withColumn("next_text", F.lead("text").over(within)).withColumn("next_fp", F.lead("fp").over(within))
    return both.where("turn = 0").drop("turn", "part")


def _search(cuts: str, n: int) -> str:
    """SQL: how many of n sorted cuts are below doc_id, by halving."""
    steps = []
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        steps.append(step)
        step //= 2
    halve = f"aggregate(array({', '.join(map(str, steps))}), 0, (at, s) -> if(at + s <= {n} and get(c, at + s - 1) < doc_id, at + s, at))"
    return f"transform(array({cuts}), c -> {halve})[0]"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    scratch = Scratch(docs.sparkSession, "imatch")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lexicon = _lexicon(rows, scratch)
    found = _with_next(rows, lexicon, scratch)
    found = found.withColumn("n_chars", F.length("text").cast("long"))
    found = found.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    found = found.withColumn("lexicon", lexicon).withColumn("kept", _kept(F.col("edited"), F.col("lexicon"))).drop("lexicon").withColumn("edited_fp", F.expr(_hashes("kept")))
    text = lambda c: F.concat_ws(".", F.transform(c, F.hex))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
        F.expr(likeness("fp", "edited_fp")).alias("near_edited"), F.expr(likeness("fp", "next_fp")).alias("near_next"),
    )
