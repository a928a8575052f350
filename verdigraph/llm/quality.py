"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is described by its words,
hashed with a sign into BUCKETS places, and by what its characters and words are like
(FEATURES); a learned layer encodes that; gated attention (tanh branch times sigmoid branch)
weighs the passages, the weighted sum represents the document, and a logistic unit scores it.
Only documents carry labels; the weights of the passages are learned from them. The model is
trained in numpy on at most SAMPLE labelled rows, taken in order of a hash of doc_id, and at
most BAG passages of each, spread evenly: documented bounds. Everything else sees all data,
and whole texts.

Defined results: a null or empty text is one passage without words and gets a score; a null
doc_id is never a training row and counts as not held out; a document labelled twice has its
lower label; rows with a null label don't train; without training rows every score is 0.5 and
predicted is 1; each repeated row is scored; other columns never are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, flat, map_batches, offsets_of, slices, unused, words_of

PASSAGE = 48
#: The most labelled rows that are used for training.
SAMPLE = 4000
#: The most passages of a row that are used for training.
BAG = 64
#: Places that words are hashed into.
BUCKETS = 128
HIDDEN, GATE = 16, 8
DECAY = 1e-3

# The kinds of bytes that are counted.
_KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?'\"",
    "loud": b"!",
    "symbol": b"*#$%&@^~=+<>_\\/",
    "table": b"|[]{}",
    "line": b"\n",
    "space": b" \t\r\x0b\x0c",
}
FEATURES = (*_KINDS, "other", "bytes_per_word", "repeated_words", "repeated_neighbours", "words", "document_repeats", "document_words")
INPUTS = len(FEATURES) + BUCKETS


def _kind_of_byte() -> np.ndarray:
    kind = np.full(256, len(_KINDS), np.uint8)
    for k, chars in enumerate(_KINDS.values()):
        kind[list(chars)] = k
    return kind


_KIND = _kind_of_byte()


def _repeats(hashes: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """For each group, how many of its words it has had before."""
    order = np.lexsort((hashes, group))
    h, g = hashes[order], group[order]
    again = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    return np.bincount(g[1:][again], minlength=groups)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of the texts, and the first passage of each text (one entry more)."""
    raw, off = offsets_of(texts)
    hashes, first, starts, _ = words_of(texts)
    counts = np.diff(first)
    bags = np.maximum(1, -(-counts // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(bags)])
    n = int(begin[-1])
    doc = np.repeat(np.arange(len(texts)), bags)
    place = np.arange(n) - begin[doc]
    word0 = first[doc] + place * PASSAGE
    word1 = np.minimum(word0 + PASSAGE, first[doc + 1])
    byte0 = np.where(place == 0, off[doc], np.append(starts, len(raw))[np.minimum(word0, len(starts))])
    kinds = _KIND[raw]
    x = np.zeros((n, INPUTS), np.float32)
    size = np.maximum(1, np.diff(np.append(byte0, len(raw))))
    if len(raw):
        edges = np.append(byte0, len(raw))
        for k in range(len(_KINDS) + 1):
            total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
            x[:, k] = np.diff(total[edges]) / size
    k = len(_KINDS) + 1
    words = (word1 - word0).astype(np.float32)
    some = np.maximum(1, words)
    x[:, k] = np.log1p(size / some) / 4
    if len(hashes):
        passage = np.repeat(np.arange(n), (word1 - word0).astype(np.int64))
        x[:, k + 1] = _repeats(hashes, passage, n) / some
        sign = 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(np.float32)
        at = passage * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        x[:, len(FEATURES) :] = np.bincount(at, sign, n * BUCKETS).reshape(n, BUCKETS) / np.sqrt(some)[:, None]
        next_to = np.zeros(len(hashes), bool)
        next_to[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        x[:, k + 2] = np.bincount(passage[next_to], minlength=n) / some
        owner = np.repeat(np.arange(len(texts)), counts)
        x[:, k + 4] = (_repeats(hashes, owner, len(texts)) / np.maximum(1, counts) / (1 + np.log1p(counts / PASSAGE)))[doc]
    x[:, k + 3] = np.log1p(words) / 4
    x[:, k + 5] = (np.log1p(counts) / 10)[doc]
    return x, begin


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict:
        w1, b1, v, u, a, c, d = self.w
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w1 + b1)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ a
        bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        e = np.exp(e - np.maximum.reduceat(e, begin[:-1])[bag])
        att = e / np.add.reduceat(e, begin[:-1])[bag]
        z = np.add.reduceat(h * att[:, None], begin[:-1])
        p = 1 / (1 + np.exp(-np.clip(z @ c + d, -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "bag": bag, "att": att, "z": z, "p": p}

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.forward(x, begin)["p"] if len(begin) > 1 else np.zeros(0)


def _weights(label: np.ndarray) -> np.ndarray:
    """Such that both labels weigh the same in all."""
    share = np.clip(label.mean(), 0.05, 0.95)
    return (np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / len(label)).astype(np.float32)


def loss(model: Model, x: np.ndarray, begin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The logistic loss of whole bags, and DECAY times half the weights' squares."""
    p = np.clip(model.forward(x, begin)["p"], 1e-12, 1 - 1e-12)
    return float(-(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() + DECAY / 2 * sum((w**2).sum() for w in model.w))


def gradients(model: Model, x: np.ndarray, begin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the loss, by each of the model's weights."""
    f = model.forward(x, begin)
    _, _, v, u, a, c, _ = model.w
    out = (f["p"] - label) * weight
    dz = out[:, None] * c
    att, h, t, s, bag = f["att"], f["h"], f["t"], f["s"], f["bag"]
    datt = (dz[bag] * h).sum(1)
    de = att * (datt - np.add.reduceat(att * datt, begin[:-1])[bag])
    dts = de[:, None] * a
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = (dz[bag] * att[:, None] + dt @ v.T + ds @ u.T) * (1 - h * h)
    found = [f["x"].T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, f["z"].T @ out, out.sum()]
    return [g + DECAY * w for g, w in zip(found, model.w, strict=True)]


def start(x: np.ndarray, seed: int = 10) -> Model:
    """An untrained model for such passages."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    shapes = [(n, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), ()]
    return Model(x.mean(0), x.std(0) + 1e-3, [np.asarray(rng.normal(0, 1 / np.sqrt(max(1, s[0] if s else 1)), s) if k not in (1, 6) else np.zeros(s), np.float32) for k, s in enumerate(shapes)])


def train(x: np.ndarray, begin: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.05, seed: int = 10) -> Model:
    """Adam on the balanced logistic loss of whole bags."""
    model, weight = start(x, seed), _weights(label)
    first, second = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w]
    for step in range(1, steps + 1):
        for k, g in enumerate(gradients(model, x, begin, label, weight)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.w[k] = model.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = flat(batch.column(2))
        for a, b in slices(texts):
            x, begin = passages(texts.slice(a, b - a))
            some = [np.unique(np.linspace(i, j - 1, min(j - i, BAG)).astype(np.int64)) for i, j in zip(begin[:-1], begin[1:], strict=True)]
            blobs = [x[rows].tobytes() for rows in some]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(blobs, pa.binary())], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the labelled documents that aren't held out, SAMPLE rows at most; None without any."""
    doc_id = F.col("doc_id").cast("long")
    marked = labels.where("doc_id is not null and quality is not null").groupBy(doc_id.alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    marked = marked.where(~held_out(F.col("doc_id")))
    ids = docs.select(doc_id.alias("doc_id")).join(marked, "doc_id").orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(SAMPLE).distinct()
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
    found = sorted(map_batches(rows, _described, "doc_id long, label int, x binary").collect(), key=lambda r: (r.doc_id, r.x))
    if not found:
        return None
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, INPUTS) for r in found])
    begin = np.concatenate([[0], np.cumsum([len(r.x) // (4 * INPUTS) for r in found])])
    return train(x, begin, np.array([r.label for r in found], np.float32))


def scored(docs: DataFrame, model: Model | None, keep_columns: bool = False) -> tuple[DataFrame, str]:
    """doc_id and score for every row of docs, or with keep_columns the columns of docs and the score; and the score's name."""
    columns = docs.columns if keep_columns else ["doc_id"]
    text_name, name = unused(docs, "vg_text", "score" if not keep_columns else "vg_score")
    rows = docs.select(*[column(c) for c in columns], F.col("text").cast("string").alias(text_name))
    schema = rows.drop(text_name).schema.add(name, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = flat(batch.column(batch.num_columns - 1))
            for a, b in slices(texts):
                p = np.full(b - a, 0.5) if model is None else model.score(*passages(texts.slice(a, b - a)))
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], pa.array(p, pa.float64())], names=[*columns, name])

    return map_batches(rows, score, schema), name


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    out, name = scored(docs, fit(docs, labels))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), column(name).alias("score"), (column(name) >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches 0.5, with their columns."""
    out, name = scored(docs, fit(docs, labels), keep_columns=True)
    return out.where(column(name) >= 0.5).drop(name)
