"""Operator 9: token ids in binary files of fixed-width packed integers.

Every id takes the fewest bits that hold the vocabulary. A file is

    magic | packed blocks | block offsets u64 | doc ids i64 | null flags u8 |
    first id of each document u64, one entry more | trailer

and its trailer holds counts, bit width and block length, so that a reader finds any id:
block = position // block length, whose bytes start at the block's offset.

The strings of the tokenizer's special tokens in a text become those tokens' ids, as the
untouched library has it; with special=False they are ordinary text.

Defined results: a null or empty text is the end id alone; null doc_ids come first;
rows with equal doc_id are ordered by text and each stays a document; an empty table
gives no documents; other columns are never read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, flat, map_batches, offsets_of, slices

MAGIC = b"VGIDS1\0\0"
TRAILER = struct.Struct("<QQQHxxI8s")  # documents, ids, index start, bits, block length, magic
BLOCK = 1 << 16
#: Bytes of text in a file, about, where the table holds more than the shuffle's partitions of it.
FILE_BYTES = 256 << 20
#: Bytes of text whose distinct pieces are encoded once: the more at a time, the fewer are met again. Spark's batches are joined up to it.
ENCODED_BYTES = 16 << 20
#: Pieces whose ids are dealt to their places at a time.
DEALT = 1 << 19
#: White space by Unicode. A space followed by one of these, or by the end, does not begin a piece.
_WS = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ODD = re.compile(f" (?:[{_WS}]|$)")
_CUT = re.compile(f" (?=[^{_WS}])")


# ---- packing ----------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit stream of ids, bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a bit stream, by one gather of five bytes for each id."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    at = np.arange(n, dtype=np.int64) * bits
    stream = np.frombuffer(raw + bytes(8), np.uint8)
    value = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        value |= stream[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Streams ids into one file; it appears under its name only when complete."""

    def __init__(self, uri: str, bits: int):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.bits, self.rest, self.held = len(MAGIC), bits, [], 0
        self.blocks, self.docs, self.nulls, self.first, self.n = [], [], [], [0], 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        ends = self.n + np.cumsum(lengths)
        self.first.extend(ends.tolist())
        self.n += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.rest)
            whole = len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(ids[k : k + BLOCK])
            self.rest, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        self.at += self.out.write(pack(ids, self.bits))

    def close(self) -> tuple[int, int]:
        if self.held:
            self._block(np.concatenate(self.rest))
        docs = np.concatenate([np.zeros(0, np.int64), *self.docs])
        for x in (np.array(self.blocks, "<u8"), docs.astype("<i8"), np.concatenate([np.zeros(0, np.uint8), *self.nulls]), np.array(self.first, "<u8")):
            self.out.write(x.tobytes())
        self.out.write(TRAILER.pack(len(docs), self.n, self.at, self.bits, BLOCK, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)
        return len(docs), self.n


class Reader:
    """Random access to one file's documents and ids."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.n_docs, self.n_ids, at, self.bits, self.block, magic = TRAILER.unpack(self._bytes(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        blocks = -(-self.n_ids // self.block)
        index = self._bytes(at, size - TRAILER.size - at)
        self.offsets = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(at))
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs, 8 * blocks)
        self.nulls = np.frombuffer(index, np.uint8, self.n_docs, 8 * (blocks + self.n_docs)).astype(bool)
        self.first = np.frombuffer(index, "<u8", self.n_docs + 1, 8 * blocks + 9 * self.n_docs).astype(np.int64)

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block_ids(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        return unpack(self._bytes(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])), n, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        return np.concatenate([self.block_ids(k) for k in range(a, b + 1)])[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


# ---- encoding -----------------------------------------------------------------------


@cache
def _tokenizer(path: str, special: bool = True):
    """The tokenizer, the bytes of text that each id stands for, and the strings that it looks for before it cuts words."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    if not special:
        tok.encode_special_tokens = True
    added = [t.content for t in tok.get_added_tokens_decoder().values() if special or not t.special]
    spans = np.zeros(tok.get_vocab_size(), np.int64)
    for word, i in tok.get_vocab().items():
        spans[i] = len(word)  # one character for each byte in a byte-level vocabulary
    return tok, spans, added


def _ids(tok, texts: list[str], at_once: int = 64) -> list[np.ndarray]:
    """Ids of each text. The library's own results take some hundred bytes an id, so few are held at a time."""
    return [np.array(e.ids, np.uint32) for k in range(0, len(texts), at_once) for e in tok.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False)]


def _encode_pieces(path: str, special: bool, pieces: pa.Array, group: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Ids of " " + piece for each piece, end to end, and their number for each piece.

    Pieces don't begin with white space, so the encoder cuts a run of them exactly where
    one begins: groups are encoded in one call each, and the ids' byte lengths say which
    ids belong to which piece.
    """
    tok, spans, _ = _tokenizer(path, special)
    words = pieces.to_pylist()
    runs = [f" {' '.join(words[k : k + group])}" for k in range(0, len(words), group)]
    coded = _ids(tok, runs)
    ids = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
    ends = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
    got = np.cumsum(spans[ids])
    stop = np.searchsorted(got, ends, "left") + 1 if len(ids) else np.zeros(len(pieces), np.int64)
    if len(pieces) and not (stop[-1] == len(ids) and np.array_equal(got[stop - 1], ends)):
        coded = _ids(tok, [f" {p}" for p in words])
        return np.concatenate(coded), np.array([len(x) for x in coded])
    return ids, np.diff(stop, prepend=0)


def _encode_whole(path: str, special: bool, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = _ids(_tokenizer(path, special)[0], texts)
    return np.concatenate([np.zeros(0, np.uint32), *coded]), np.array([len(x) for x in coded], np.int64)


def encode(path: str, texts: pa.Array, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the whole texts end to end, and each text's number of ids.

    A byte-level vocabulary's pre-tokeniser never joins a space that has a visible
    character behind it to what stands before it, so a text falls into pieces there, and
    each distinct piece of a batch is encoded once. Texts that hold an added token's string
    are encoded whole, as the library cuts there first.
    """
    tok, _, added = _tokenizer(path, special)
    if tok.normalizer is not None or type(tok.pre_tokenizer).__name__ != "ByteLevel":
        return _encode_whole(path, special, texts.to_pylist())
    holds = np.zeros(len(texts), bool)
    for word in added:
        holds |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
    if not holds.any():
        return _encode_split(path, special, texts)
    parts = [(np.flatnonzero(holds), *_encode_whole(path, special, texts.filter(pa.array(holds)).to_pylist()))]
    if not holds.all():
        parts.append((np.flatnonzero(~holds), *_encode_split(path, special, texts.filter(pa.array(~holds)))))
    each: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    for rows, ids, lengths in parts:
        for k, own in zip(rows.tolist(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            each[k] = own
    return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def _encode_split(path: str, special: bool, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """encode() of texts without any added token's string."""
    tok, _, _ = _tokenizer(path, special)
    lists = pc.split_pattern(texts, " ")
    odd = pc.match_substring_regex(texts, " (?:[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\pZ]|$)").to_numpy(zero_copy_only=False)
    if odd.any():
        lists = pa.array([_CUT.split(t) if o else p for t, o, p in zip(texts.to_pylist(), odd, lists.to_pylist(), strict=True)], pa.large_list(pa.large_string()))
    first = np.asarray(lists.offsets, dtype=np.int64)
    first, values = first - first[0], lists.flatten()
    coded = values.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, counts = _encode_pieces(path, special, coded.dictionary)
    # a text's first piece has no space before it
    heads = _ids(tok, values.take(pa.array(first[:-1])).to_pylist())
    starts = np.append(np.cumsum(counts) - counts, len(ids) + np.cumsum([0, *map(len, heads)])[:-1])
    counts = np.append(counts, [len(h) for h in heads]).astype(np.int64)
    ids = np.concatenate([ids, *heads])
    index[first[:-1]] = len(coded.dictionary) + np.arange(len(heads))
    sizes = counts[index]
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    for k in range(0, len(index), DEALT):
        size, end = sizes[k : k + DEALT], ends[k : k + DEALT]
        at = np.repeat(starts[index[k : k + DEALT]] - (end - size), size)
        at += np.arange(end[0] - size[0], end[-1])
        out[end[0] - size[0] : end[-1]] = ids[at]
    return out, np.add.reduceat(sizes, first[:-1]) if len(sizes) else np.zeros(0, np.int64)


def _with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32), lengths + 1


# ---- Spark -------------------------------------------------------------------------


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, special: bool = True) -> list[tuple[str, int, int]]:
    """Writes every document of docs (doc_id, text) to files in folder, in ascending doc_id order.

    One file for each range of doc_id, of about FILE_BYTES of text where there is that much
    and partitions isn't given; a task that is run again replaces its own file.
    Returns (file, documents, ids) by file in order: as many as partitions.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        uri = f"{folder}/part-{part:06d}.vgids"
        for doc_ids, texts in joined(batches):
            for a, b in slices(texts, ENCODED_BYTES):
                if out is None:
                    out = Writer(uri, bits_for(max(_tokenizer(tokenizer)[0].get_vocab_size(), end_id + 1)))
                out.add(doc_ids.slice(a, b - a), *_with_end(*encode(tokenizer, texts.slice(a, b - a), special), end_id))
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [uri], "docs": [n_docs], "ids": [n_ids]})

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = map_batches(dealt, files, "part long, file string, docs long, ids long").collect()
    return [(r.file, r.docs, r.ids) for r in sorted(done, key=lambda r: r.part)]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc ids, texts) of batches in order, as many together as have ENCODED_BYTES of text at most."""
    held, size = [], 0
    for batch in batches:
        texts = flat(batch.column(1))
        n = len(offsets_of(texts)[0])
        if held and size + n > ENCODED_BYTES:
            yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
            held, size = [], 0
        held.append((batch.column(0), texts))
        size += n
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))


def read_tokens(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    bases = np.cumsum([0, *(n for _, _, n in files)]).tolist()
    paths = [f for f, _, _ in files]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                x = Reader(paths[k])
                sums, d = [0] * x.n_docs, 0
                for b in range(len(x.offsets) - 1):
                    at, ids = b * x.block, x.block_ids(b).astype("<u4")
                    stop = at + len(ids)
                    while d < x.n_docs and x.first[d] < stop:
                        sums[d] = zlib.crc32(ids[max(0, int(x.first[d]) - at) : int(x.first[d + 1]) - at], sums[d])
                        if x.first[d + 1] > stop:
                            break
                        d += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.doc_ids, mask=x.nulls), pa.array(x.first[:-1] + bases[k]), pa.array(np.diff(x.first)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, len(files))
    return map_batches(spark.range(0, len(files), 1, n), rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, special: bool = True) -> DataFrame:
    """Writes the documents' ids to files and reads them back.

    The files stay in folder; without one they are in a new folder in the shared one, which goes at the end of the session.
    """
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, folder or Scratch(spark, "tokens").root, tokenizer, end_id, special=special))
