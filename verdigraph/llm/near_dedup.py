"""Operator 5: near-duplicates by circulant MinHash, banding and exact Jaccard.

A text's shingles (distinct five-word runs) are permuted once (sigma) and a second
permutation (pi), shifted by k around its circle, gives signature coordinate k: the least
pi(sigma(shingle) + k mod 2^32). Both are bijections of the 32-bit integers. BANDS bands of
ROWS coordinates deal the texts into buckets; two texts of similarity 0.75 miss each other
in all of them with probability (1 - 0.75^ROWS)^BANDS, about 5e-6.

Pairs of a bucket are confirmed on the full shingle sets, but not all are formed. Texts with
equal sets are one class from the start. Each member is compared with its bucket's smallest,
in the first bands and then, where it isn't in one component with it yet, in the others. For the members of buckets that still lie in several
components, all similar pairs across components are found by an exact prefix filter on their
full sets, so that no link between different texts is given up and no group's pairs are
all formed.

Defined results: a text without words (or null) has an empty set and is linked with nothing;
a text of one to four words has one shingle, its whole sequence; a null doc_id is never
linked and has a null component_id, and is kept; rows with the same doc_id are one document
with several texts, whose links all count; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat, map_batches, mix64, slices, unused, words_of

WORDS = 5
ROWS, BANDS = 5, 45
#: Bands that are compared before the others.
FIRST = 9
#: Shingle places that are counted for the prefix filter's order, and what makes one crowded.
CELLS, CROWD = 22, 24
#: A set of doc_ids that is sent to the texts has 2^SPARE places for each of them, and no more than 2^IDS: beyond, texts and ids are joined.
SPARE, IDS = 4, 26
#: Copies from which a class of equal sets is met by a broadcast row instead of a shuffle on its digest: one in so many rows at most is such a class.
HOT = 1 << 20
#: 100 * intersection >= PERCENT * union
PERCENT = 75

_rng = np.random.default_rng(5)
_WEIGHT = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGMA = np.uint64(_rng.integers(1, 2**63))
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.arange(ROWS * BANDS, dtype=np.uint32)[:, None]


def _pi(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's set of shingles: sorted 64-bit hashes."""
    words, first, _, _ = words_of(column)
    runs = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        runs += words[k : k + len(runs)] * _WEIGHT[k]
    runs = mix64(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(runs[a : b - WORDS + 1])
        elif b > a:
            yield mix64(np.sum(words[a:b] * _WEIGHT[: b - a], keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signature(found: np.ndarray, step: int = 2048) -> np.ndarray:
    """Circulant MinHash of a non-empty set: ROWS * BANDS coordinates."""
    places = (mix64(found * _SIGMA) >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(places), step):
        np.minimum(least, _pi(places[k : k + step] + _SHIFT).min(axis=1), out=least)
    return least


def bands(coordinates: np.ndarray) -> np.ndarray:
    """A bucket for each band, as 64-bit integers that differ from band to band."""
    rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    return mix64((rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = flat(batch.column(1))
        for a, b in slices(texts):
            sizes, high, low, keys = [], [], [], []
            for found in shingles(texts.slice(a, b - a)):
                sizes.append(len(found))
                # of the whole set, so that equal digests stand for equal sets
                one, two = struct.unpack("<qq", hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                high.append(one)
                low.append(two)
                keys.append(bands(signature(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "h1", "h2", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = flat(batch.column(1))
        for a, b in slices(texts):
            blobs = [found.tobytes() for found in shingles(texts.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(blobs, pa.binary())], names=["id", "set"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.concatenate([p, q])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * shared >= PERCENT * (len(both) - shared))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(id, comp) of every id in edges (a, b): the smallest id that can be reached.

    Each round points every neighbour of a node at the node's smallest one, first the larger
    neighbours, then the smaller ones, until nothing moves: few rounds even for long chains.
    """
    at = scratch.save(edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u > v").distinct(), f"{label}-0")
    mark, k = None, 0
    while True:
        k += 1
        both = at.union(at.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u > v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").selectExpr("explode(array(struct(u as u, m as v), struct(v as u, m as v))) as e").selectExpr("e.u as u", "e.v as v").where("u > v").distinct()
        new = scratch.save(small, f"{label}-{k}")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        scratch.drop(f"{label}-{k - 1}")
        at = new
        if now == mark:
            break
        mark = now
    return at.selectExpr("u as id", "v as comp")


def _sizes(a: str, b: str) -> str:
    """SQL: sets of these sizes can be similar enough."""
    return f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})"


def _mixed(buckets: DataFrame, comps: DataFrame, least: int) -> DataFrame:
    """Members (id, n, key, comp, pivot) of the buckets of so many members that lie in several components."""
    named = buckets.select("id", "n", "key").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = named.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("id", "n", "comp")).alias("pivot"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    return named.join(mixed.where(f"members >= {least} and c1 != c2").select("key", "pivot"), "key")


def _sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the texts with these distinct doc_ids, and of a few more.

    The ids go to the texts as a set of places, so that texts needn't be shuffled; its size
    follows their number, and a place may stand for several ids. More ids than such a set
    holds are joined with the texts.
    """
    bits = max(10, ids.count().bit_length() + SPARE)
    if bits > IDS:
        return map_batches(rows.join(ids.selectExpr("id as doc_id"), "doc_id", "left_semi").select("doc_id", "text"), _sets, "id long, set binary")
    place = f"(id ^ shiftright(id, {bits}) ^ shiftright(id, {2 * bits})) & {2**bits - 1}"
    words = ids.selectExpr(f"{place} as p").selectExpr("cast(shiftright(p, 6) as int) as k", "shiftleft(1L, cast(p & 63 as int)) as bit").groupBy("k").agg(F.bit_or("bit").alias("bits")).collect()
    wanted = np.zeros(2**bits // 64, np.int64)
    for w in words:
        wanted[w.k] = w.bits

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            p = (i ^ (i >> bits) ^ (i >> (2 * bits))) & (2**bits - 1)
            keep = ((wanted[p >> 6] >> (p & 63)) & 1).astype(bool) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if keep.any():
                yield from _sets(iter([batch.filter(pa.array(keep))]))

    return map_batches(rows, sets, "id long, set binary")


def _confirm(pairs: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = scratch.save(pairs.selectExpr("explode(array(a, b)) as id").distinct(), f"{name}-ids")
    sets = scratch.save(_sets_of(rows, ids), name)
    held = pairs.join(sets.selectExpr("id as a", "set as sa"), "a").join(sets.selectExpr("id as b", "set as sb"), "b")
    return map_batches(held.select("a", "b", "sa", "sb"), _linked, "a long, b long")


def _prefix_pairs(sets: DataFrame, left: DataFrame) -> DataFrame:
    """All pairs (a, b) across components that can be similar enough, by the prefix filter.

    With all sets in one order, similar sets of n shingles share one of their first
    n - ceil(n * PERCENT / 100) + 1, and, as the two sizes settle how many they must share,
    one whose places in both sets leave enough behind it. Shingles of crowded places come last in that order, so
    that a passage which many texts share pairs only texts that hold little else.
    """
    places = 2**CELLS
    cells = map_batches(sets, _cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").alias("n")).first().n or 0
    busy = cells.where(F.col("n") >= max(CROWD, 4 * total / places))
    words = busy.selectExpr("cast(shiftright(cell, 6) as int) as k", "shiftleft(1L, cell & 63) as bit").groupBy("k").agg(F.bit_or("bit").alias("bits")).collect()
    crowded = np.zeros(places // 64, np.int64)  # the places' bit set: no more than 2^CELLS bits
    for w in words:
        crowded[w.k] = w.bits

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for x in batch.column(1):
                found = np.frombuffer(x.as_py(), np.uint64)
                at = (found & np.uint64(places - 1)).astype(np.int64)
                late = (crowded[at >> 6] >> (at & 63)) & 1
                need = -(-len(found) * PERCENT // 100)
                keys.append(found[np.lexsort((found, late))[: len(found) - need + 1]].view(np.int64) if len(found) else [])
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "keys"])

    rows = map_batches(sets, prefixes, "id long, n long, keys array<bigint>").join(left, "id").select("id", "n", "comp", F.posexplode("keys").alias("at", "key"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2").select("key")
    rows = rows.join(mixed, "key", "left_semi")
    a, b = rows.selectExpr("key", "id as a", "n as na", "comp as ca", "at as pa"), rows.selectExpr("key", "id as b", "n as nb", "comp as cb", "at as pb")
    need = f"({PERCENT} * (na + nb) + {PERCENT + 99}) div {PERCENT + 100}"  # shared shingles of a similar pair, rounded up
    near = f"a < b and ca != cb and {_sizes('na', 'nb')} and pa <= na - {need} and pb <= nb - {need}"
    return a.join(b, "key").where(near).select("a", "b").distinct()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall into each of 2^CELLS places."""
    count = np.zeros(2**CELLS, np.int64)
    for batch in batches:
        for x in batch.column(1):
            at = (np.frombuffer(x.as_py(), np.uint64) & np.uint64(2**CELLS - 1)).astype(np.int64)
            np.add.at(count, at, 1)
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], names=["cell", "n"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(map_batches(rows, _signed, "doc_id long, n long, h1 long, h2 long, keys array<bigint>"), "signed")

    full = signed.where("n > 0 and doc_id is not null")
    classes = scratch.save(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    heads = full.join(classes.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi")
    heads = scratch.save(heads.dropDuplicates(["h1", "h2"]).select(F.col("doc_id").alias("id"), "n", "keys"), "heads")
    # equal doc_ids tie their texts' classes together, as do links
    tied = full.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    tied = full.join(tied, "doc_id").join(classes, ["h1", "h2"]).selectExpr("doc_id as a", "rep as b").where("a != b")

    rows_of = heads.select("id", "n", F.posexplode("keys").alias("band", "key"))
    shared = rows_of.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("pivot")).where("members > 1")
    buckets = scratch.save(rows_of.join(shared.select("key", "pivot"), "key"), "buckets")

    # the first bands tie most groups together, so that the others' buckets need few comparisons
    star = buckets.where(f"band < {FIRST} and id != pivot.id and {_sizes('n', 'pivot.n')}")
    first = scratch.save(star.selectExpr("pivot.id as a", "id as b").distinct(), "pairs-0")
    linked = scratch.save(tied.union(_confirm(first, rows, scratch, "sets-0")), "edges-0")
    comps = components(linked, scratch, "comps-0")

    mixed = _mixed(buckets, comps, 2)
    star = mixed.where(f"comp != pivot.comp and {_sizes('n', 'pivot.n')}").selectExpr("pivot.id as a", "id as b").distinct()
    second = scratch.save(star.join(first, ["a", "b"], "left_anti"), "pairs-1")
    linked = scratch.save(linked.union(_confirm(second, rows, scratch, "sets-1")), "edges-1")
    comps = components(linked, scratch, "comps-1")

    # the members of buckets that still lie in several components
    left = scratch.save(_mixed(buckets, comps, 3).select("id", "comp").distinct(), "left")
    if not left.isEmpty():
        sets = scratch.save(_sets_of(rows, left.select("id")), "sets-2")
        third = scratch.save(_prefix_pairs(sets, left).join(first.union(second), ["a", "b"], "left_anti"), "pairs-2")
        linked = scratch.save(linked.union(_confirm(third, rows, scratch, "sets-3")), "edges-2")
        comps = components(linked, scratch, "comps-2")

    found = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "copies", F.coalesce("comp", "rep").alias("component"))
    found = scratch.save(found, "found")
    for name in ("heads", "buckets", "sets-0", "sets-1", "sets-2", "sets-3"):
        scratch.drop(name)
    # texts without words have no class; classes with very many copies, a few, don't meet their rows in one task
    bare, some = signed.drop("keys").where("n = 0"), signed.drop("keys").where("n > 0")
    hot = found.where(F.col("copies") >= HOT).drop("copies")
    out = some
    if not hot.isEmpty():
        hot = F.broadcast(hot)
        out = some.join(hot, ["h1", "h2"], "left_anti")
        bare = bare.withColumn("component", F.lit(None).cast("long")).unionByName(some.join(hot, ["h1", "h2"]))
    else:
        bare = bare.withColumn("component", F.lit(None).cast("long"))
    out = out.join(found.drop("copies"), ["h1", "h2"], "left").unionByName(bare)
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.least("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document stays: one document of each component."""
    (name,) = unused(docs, "vg_kept_id")
    stays = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stays, F.col("doc_id").cast("long") == F.col(name), "left_semi").unionByName(docs.where("doc_id is null"))


#: Exact links between all pairs that share a shingle, for tables of a few thousand rows.
ORACLE = r"""
with recursive
words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end as s from words),
reps as (select min(doc_id) as id, s, len(s) as n from (select doc_id, list_sort(s) as s from sets) group by s),
parts as (select id, n, unnest(s) as t from reps),
pairs as (
  select a.id as a, b.id as b from parts a join parts b on a.t = b.t and a.id < b.id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by a.id, b.id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union select b, a from pairs),
reach as (select id as src, id as dst from reps union select r.src, e.b from reach r join edges e on r.dst = e.a),
comps as (select src as id, min(dst) as component from reach group by src)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles,
       case when len(d.s) = 0 then d.doc_id else c.component end as component_id,
       case when len(d.s) = 0 then true else d.doc_id = c.component end as kept
from sets d left join reps r on list_sort(d.s) = r.s left join comps c on c.id = r.id
"""
