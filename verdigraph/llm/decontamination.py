"""Operator 3: benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most PASSAGE words, the stated query set, which
is taken in blocks of PASSAGES of them; GROUP blocks share their passes over the corpus: one
counts the inverse document frequency of all their terms over all documents, one searches. A
randomised SVD of a block's TF-IDF passages (range finder and power steps as sums over
partitions) gives its latent space. Every corpus text is folded in whole, STEP words by STEP
words, and blocks and runs of three are compared with every passage by cosine, and by how
much of its length they cover. Candidates that can't hold enough of a passage's terms, by an
upper bound over the terms that retrieve, are dropped before they are aligned.

A candidate is confirmed by the longest common subsequence of passage and run, weighted by
idf so that function words alone confirm nothing; a passage whose phrases stand in another
order is held by nearly all its terms and a shorter subsequence. One that isn't there nearly
whole (a paraphrase) also needs the item's answer: its last quarter, ANSWER_WORDS at most.

Terms are the texts' words in lower case; ASCII punctuation counts as white space, so loud, starred or tabulated
copies are found as well.

Defined results: a null or empty text, or one without words of the benchmark, matches
nothing; a null doc_id is reported as null; repeated rows are reported once as pairs and each
is dropped from a filtered corpus; null or empty benchmark texts are no items; equal items
are each reported; an empty benchmark leaves everything; other columns go along unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, flat, map_batches, offsets_of, slices, unused

PASSAGE, STEP, WIDTHS = 64, 32, (1, 3)
#: Passages in a block of the query set, and blocks that share passes over the corpus.
PASSAGES, GROUP = 2000, 4
RANK = 256
COSINE = 0.4
#: A run must also cover this share of the passage's own energy: one rare word makes a run look alike, not long enough.
COVER = 0.4
#: Shares of the passage's weight that must be common: to confirm with the answer, and without a look at it.
SHARE, WHOLE, ANSWER = 0.5, 0.9, 0.5
#: Instead of SHARE: so much of its different terms' weight, so much of its weight in order, for passages of so many different terms.
HELD, MOVED, DIFFERENT = 0.9, 0.3, 8
ANSWER_WORDS = 16
#: Runs that are compared with a block's passages at a time.
RUNS = 1 << 10
#: Terms in more than this share of documents don't retrieve; they count in confirmation.
COMMON = 0.05
#: But where the others hold less than this share of a passage's weight (it leaked into many documents), all its terms retrieve.
RETRIEVING = 0.6


#: ASCII punctuation becomes white space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms end to end, and the first of each text (one entry more)."""
    raw, off = offsets_of(pc.utf8_lower(column))
    plain = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(_PLAIN[raw]))
    lists = pc.ascii_split_whitespace(plain)
    first = np.asarray(lists.offsets, dtype=np.int64)
    return lists.flatten(), first - (first[0] if len(first) else 0)


def _known(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(terms, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Passage:
    """A piece of an item: its terms, the item's answer, and how many of the item's words come after it."""

    item: int
    terms: list[str]
    answer: list[str]
    after: int


@dataclass
class Query:
    """A block of the benchmark, ready to search with. Terms are places in its own vocabulary."""

    place: np.ndarray  # of each term of the group's vocabulary, -1 where it isn't of this block; one entry more for unknown terms
    items: np.ndarray  # of each passage
    words: list[np.ndarray]
    answers: list[np.ndarray]
    after: np.ndarray
    idf: np.ndarray
    basis: np.ndarray  # vocabulary x rank, weighted by idf; common terms are 0
    latent: np.ndarray  # passages x rank, of length 1
    norm: np.ndarray  # of each passage before that
    starts: np.ndarray  # of each term's passages in holders; terms that don't retrieve have none
    holders: np.ndarray
    need: np.ndarray  # of each passage: the weight of retrieving terms without which it can't be confirmed

    def retrieving(self) -> np.ndarray:
        return np.flatnonzero(np.abs(self.basis).sum(1) > 0)


def _passages(item: int, text: str) -> list[Passage]:
    terms, _ = terms_of(pa.array([text], pa.large_string()))
    words = [w for w in terms.to_pylist() if w]
    answer = words[-max(min(5, len(words)), min(ANSWER_WORDS, len(words) // 4)) :]
    edges = np.linspace(0, len(words), max(1, math.ceil(len(words) / PASSAGE)) + 1).astype(int).tolist()
    return [Passage(item, words[a:b], answer, len(words) - b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _blocks(benchmark: DataFrame) -> Iterator[list[Passage]]:
    """The benchmark's passages, PASSAGES at a time, by item_id; a long item's go on in the next block."""
    block: list[Passage] = []
    for row in benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        for passage in _passages(row[0], row[1]):
            block.append(passage)
            if len(block) == PASSAGES:
                yield block
                block = []
    if block:
        yield block


def _document_frequency(docs: DataFrame, vocabulary: pa.Array) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            texts = flat(batch.column(0))
            n += len(texts)
            for a, b in slices(texts):
                terms, first = terms_of(texts.slice(a, b - a))
                known = _known(terms, vocabulary)
                key = np.repeat(np.arange(b - a), np.diff(first)) * (len(vocabulary) + 1) + known + 1
                at = np.unique(key) % (len(vocabulary) + 1)
                df += np.bincount(at, minlength=len(vocabulary) + 1)[1:]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["term", "df"])

    rows = map_batches(docs.select(F.col("text").cast("string")), count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    found, n = np.zeros(len(vocabulary), np.int64), 0
    for r in rows:  # one row for each term of this block of the benchmark
        if r.term < 0:
            n = r.df
        else:
            found[r.term] = r.df
    return found, n


def _latent_space(spark, words: list[np.ndarray], weight: np.ndarray, seed: int = 3, power: int = 2) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages' TF-IDF matrix A.

    Each pass sends the current basis W to the passages' partitions, which return their part
    of A^T (A W), the rows of their own terms; the sum is made orthonormal on the driver. Terms
    are bounded by the block: PASSAGES * PASSAGE.
    """
    n = len(weight)
    rank = min(RANK, len(words), n)
    basis = np.random.default_rng(seed).normal(size=(n, rank + 8)).astype(np.float32)
    rows = spark.createDataFrame([(w.astype(np.int32).tobytes(),) for w in words], "w binary").repartition(max(1, min(8, len(words) // 200 + 1)))
    for _ in range(power + 1):

        def sketch(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            total, met = np.zeros(basis.shape, np.float32), np.zeros(len(basis), bool)
            for batch in batches:
                for w in batch.column(0):
                    at = np.frombuffer(w.as_py(), np.int32)
                    row = weight[at] / max(1e-9, np.linalg.norm(weight[at]))
                    np.add.at(total, at, row[:, None] * (row @ basis[at]))
                    met[at] = True
            own = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), pa.array([total[own].tobytes()], pa.binary())], names=["terms", "part"])

        total = np.zeros(basis.shape)
        for p in map_batches(rows, sketch, "terms binary, part binary").collect():
            own = np.frombuffer(p.terms, np.int64)
            total[own] += np.frombuffer(p.part, np.float32).reshape(len(own), basis.shape[1])
        basis = np.linalg.qr(total)[0].astype(np.float32)
    return basis[:, :rank]


def _query(spark, block: list[Passage], vocabulary: pa.Array, df: np.ndarray, n: int) -> Query:
    own = np.unique(_known(pa.array([w for p in block for w in {*p.terms, *p.answer}], pa.large_string()), vocabulary))
    place = np.full(len(vocabulary) + 1, -1, np.int64)
    place[own] = np.arange(len(own))
    local = lambda terms: place[_known(pa.array(terms, pa.large_string()), vocabulary)]
    words = [local(p.terms) for p in block]
    idf = np.log((n + 1) / (df[own] + 1)).astype(np.float32) + np.float32(1e-3)
    weight = np.where(df[own] > max(COMMON * n, 3), 0, idf).astype(np.float32)
    for w in words:
        if weight[w].sum() < RETRIEVING * idf[w].sum():
            weight[w] = idf[w]
    basis = weight[:, None] * _latent_space(spark, words, weight)
    latent = np.stack([basis[w].sum(0) for w in words])
    norm = np.linalg.norm(latent, axis=1)
    unit = np.divide(latent, norm[:, None], out=np.zeros_like(latent), where=norm[:, None] > 1e-6)
    retrieves = np.abs(basis).sum(1) > 0
    pairs = np.concatenate([np.stack([u, np.full(len(u), k)], 1) for k, u in enumerate(map(np.unique, words))])
    need = np.array([(0.9 * SHARE - 1e-4) * idf[u].sum() - idf[u[~retrieves[u]]].sum() for u in map(np.unique, words)], np.float32)
    pairs = pairs[retrieves[pairs[:, 0]]]
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    starts = np.searchsorted(pairs[:, 0], np.arange(len(own) + 1))
    return Query(place, np.array([p.item for p in block], np.int64), words, [local(p.answer) for p in block], np.array([p.after for p in block], np.int64), idf, basis, unit, norm, starts, pairs[:, 1].copy(), need)


@dataclass
class Group:
    """Blocks that are searched for in one pass."""

    vocabulary: pa.Array
    queries: list[Query]


def prepare(docs: DataFrame, benchmark: DataFrame) -> Iterator[Group]:
    """The benchmark's groups of blocks, with statistics over all documents."""
    blocks = _blocks(benchmark)
    while group := list(islice(blocks, GROUP)):
        vocabulary = pa.array(sorted({w for block in group for p in block for w in (*p.terms, *p.answer)}), pa.large_string())
        df, n = _document_frequency(docs, vocabulary)
        yield Group(vocabulary, [_query(docs.sparkSession, block, vocabulary, df, n) for block in group])


def common_weight(passage: np.ndarray, run: np.ndarray, idf: np.ndarray) -> float:
    """Weight of the heaviest common subsequence."""
    best = np.zeros(len(run) + 1, np.float32)
    for w in passage.tolist():
        np.maximum(best[1:], best[:-1] + np.where(run == w, idf[w], np.float32(-1e9)), out=best[1:])
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


def confirmed(passage: np.ndarray, run: np.ndarray, idf: np.ndarray, answer: np.ndarray | None = None, rest: np.ndarray | None = None) -> tuple[float, float] | None:
    """Shares of the passage that run has in order, and of the answer that run, or what follows it too, has, if they are enough."""
    inside = run[np.isin(run, passage)]
    unique = np.unique(passage)
    held = float(idf[np.intersect1d(unique, inside)].sum()) / float(idf[unique].sum())
    if not len(inside) or held < 0.9 * SHARE:
        return None
    share = common_weight(passage, inside, idf) / float(idf[passage].sum())
    moved = held >= HELD and share >= MOVED and len(unique) >= DIFFERENT
    if share < SHARE and not moved:
        return None
    if answer is None:
        answer = passage[-max(min(5, len(passage)), min(ANSWER_WORDS, len(passage) // 4)) :]
    where = run if rest is None else rest
    where = where[np.isin(where, answer)]
    has = common_weight(answer, where, idf) / float(idf[answer].sum())
    if moved:
        terms = np.unique(answer)
        has = max(has, float(idf[np.intersect1d(terms, where)].sum()) / float(idf[terms].sum()))
    return (share, has) if share >= WHOLE or has >= ANSWER else None


def _near(query: Query, known: np.ndarray, block: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
    """(first block, passage, cosine, width) of runs of blocks that may hold a passage."""
    useful = np.zeros(len(query.idf) + 1, bool)
    useful[query.retrieving()] = True
    at = np.flatnonzero(useful[known])
    if not len(at):
        return
    blocks, passages = len(owner), len(query.words)
    vectors = np.zeros((blocks, query.basis.shape[1]), np.float32)
    for k in range(0, len(at), 1 << 15):
        part = at[k : k + (1 << 15)]
        own, where = np.unique(block[part], return_index=True)
        vectors[own] += np.add.reduceat(query.basis[known[part]], where)
    # each block's different retrieving terms, in order of blocks
    pairs = np.unique(block[at] * len(query.idf) + known[at])
    of_block, term = pairs // len(query.idf), pairs % len(query.idf)
    widest = max(WIDTHS)
    for k in range(0, blocks, RUNS):
        stop = min(blocks, k + RUNS)
        # weight of a passage's terms in each block from the one before the runs to the one after them
        lo, hi = max(0, k - 1), min(blocks, stop + widest)
        a, b = np.searchsorted(of_block, [lo, hi])
        counts = query.starts[term[a:b] + 1] - query.starts[term[a:b]]
        into = np.repeat(np.arange(b - a), counts)
        spot = np.arange(len(into)) - np.repeat(np.cumsum(counts) - counts, counts) + query.starts[term[a:b]][into]
        held = np.bincount((of_block[a:b][into] - lo) * passages + query.holders[spot], query.idf[term[a:b]][into], (hi - lo) * passages).reshape(hi - lo, passages)
        total = np.concatenate([np.zeros((1, passages)), np.cumsum(held, axis=0)])
        for width in WIDTHS:
            run = vectors[k:stop].copy()
            own = owner[k:stop]
            for step in range(1, width):
                more = vectors[k + step : stop + step]
                same = owner[k + step : stop + step] == own[: len(more)]
                run[: len(more)][same] += more[same]
            norm = np.linalg.norm(run, axis=1)
            product = run @ query.latent.T
            near = (product >= COSINE * norm[:, None]) & (product >= np.maximum(COVER * query.norm, 1e-6))
            first = np.maximum(np.arange(k, stop) - 1, lo) - lo
            last = np.minimum(np.arange(k, stop) + width + 1, hi) - lo
            near &= total[last] - total[first] >= query.need - 1e-3
            for r, p in zip(*np.nonzero(near), strict=True):
                yield int(k + r), int(p), float(product[r, p] / norm[r]), width


def search(group: Group, texts: pa.Array, tally: list[int] | None = None) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, cosine, share, answer share) of each text and item that it holds; tally[0] counts the candidates that are aligned."""
    terms, first = terms_of(texts)
    places = _known(terms, group.vocabulary)
    counts = np.diff(first)
    blocks = -(-counts // STEP)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    doc = np.repeat(np.arange(len(texts)), counts)
    block = begin[doc] + (np.arange(len(places)) - first[doc]) // STEP
    owner = np.repeat(np.arange(len(texts)), blocks)
    told: set[tuple[int, int]] = set()
    for query in group.queries:
        known = query.place[places]
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for b, p, cosine, width in _near(query, known, block, owner):
            found.setdefault((int(owner[b]), p), []).append((cosine, b, width))
        for (d, p), runs in sorted(found.items()):
            item = int(query.items[p])
            if (d, item) in told:
                continue
            seen: set[tuple[int, int]] = set()
            for cosine, b, width in sorted(runs, reverse=True):
                lo = first[d] + max(0, b - begin[d] - 1) * STEP
                hi = min(first[d + 1], first[d] + (b - begin[d] + width + 1) * STEP)
                if any(x <= lo and hi <= y for x, y in seen):
                    continue
                seen.add((lo, hi))
                if tally is not None:
                    tally[0] += 1
                rest = known[lo : min(first[d + 1], hi + query.after[p] + (STEP if query.after[p] else 0))]
                if (shares := confirmed(query.words[p], known[lo:hi], query.idf, query.answers[p], rest)) is not None:
                    told.add((d, item))
                    yield d, item, cosine, *shares
                    break


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, answer_share of every document and item that it holds."""
    schema = "doc_id long, item_id long, cosine double, share double, answer_share double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for group in prepare(docs, benchmark):

        def find(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = flat(batch.column(1))
                for a, b in slices(texts):
                    hits = list(search(group, texts.slice(a, b - a)))
                    ids = batch.column(0).slice(a, b - a).take(pa.array([h[0] for h in hits], pa.int64()))
                    rest = [pa.array([h[k] for h in hits], pa.int64() if k == 1 else pa.float64()) for k in range(1, 5)]
                    yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "cosine", "share", "answer_share"])

        part = map_batches(rows, find, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "share", "answer_share")])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    out, names = docs, docs.columns
    for group in prepare(docs, benchmark):
        rows = out.select(*[column(c) for c in names], F.col("text").cast("string").alias(unused(docs, "vg_text")[0]))

        def keep(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = flat(batch.column(batch.num_columns - 1))
                stays = np.ones(len(texts), bool)
                for a, b in slices(texts):
                    for hit in search(group, texts.slice(a, b - a)):
                        stays[a + hit[0]] = False
                left = batch.filter(pa.array(stays))
                yield pa.RecordBatch.from_arrays(left.columns[:-1], names=names)

        out = map_batches(rows, keep, docs.schema)
    return out
