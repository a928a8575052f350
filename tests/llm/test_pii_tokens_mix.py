import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigraph.llm import mixing, private_data, token_output
from verdigraph.llm.common import BATCH_BYTES, map_batches

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")

TEXTS = [
    "Call +49 (30) 1234-5678 or mail a.b+c@x.example.org.de, card 4111 1111 1111 1111 and 4111-1111-1111-1112; host 10.0.0.255, 1.2.3.256.",
    "IBAN DE89 3704 0044 0532 0130 00 and social security 123-45-6789, @x.y a@@b.c d@e é@é.fr x@y.z@q.r",
    "", None, "1.2.3.4.5.6.7.8 +1234567890123456 +1 555 1234567 4532015112830366", "plain words only", "plain words only",
    "line\n\n two  spaces \t tab  nb x   end ", "é" * 5000, " lead", "<|endoftext|> ''s don't I'LL 12 345",
]


def spans_by_contract(t):
    base = {"email": private_data._EMAIL, "ip": private_data._IP, "card": private_data._CARD, "phone": private_data._PHONE}
    out = []
    for kind, p in base.items():
        for m in p.finditer(t or ""):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in s.split(".")) or kind == "phone" and 9 <= len(d) <= 15 or kind == "card" and 13 <= len(d) <= 19 and private_data.luhn(d):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def docs_of(spark):
    rows = [(i if i != 5 else None, t, ["b", None, "a"][i % 3], i) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")


def test_spans_are_those_of_the_contract(spark):
    rows = private_data.digest(private_data.spans(docs_of(spark))).collect()
    assert len(rows) == len(TEXTS) + 1
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(TEXTS):
        want = spans_by_contract(t)
        r = got[i if i != 5 else None]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.spans.split(",")[: len(want)] == (want or [""])[: len(want)] and r.n_email == sum(w.startswith("email") for w in want)
    assert [s.split(":")[0] for s in got[1].spans.split(",")][-2:] == ["iban", "ssn"]
    assert private_data.redact("mail a@b.co now") == "mail [email] now"


def test_account_numbers_and_secrets():
    def kinds(t):
        return [(k, t[a:b]) for k, a, b, _ in private_data.find_spans(t) if k not in private_data.BASE]

    for iban in ("ES9121000418450200051332", "AT611904300234573201", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"):
        for after in ("", " EUR", " VISA", " BIC", ".", " A1", " ABCD EFGH"):
            assert kinds(f"order {iban}{after}") == [("iban", iban)], iban + after
        assert not kinds(iban[:-1] + str((int(iban[-1]) + 1) % 10))
    assert kinds("ZZ6810000000000000000 ABC") == [("iban", "ZZ6810000000000000000")] if private_data.mod97("ZZ6810000000000000000") else True
    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert kinds("PASSWORD: hunter2hunter9x.") == [("secret", "hunter2hunter9x")]
    assert not kinds("the token of aaaaaaaaaaaaaaaaaaaa") and not kinds("token: 111111111111111111") and not kinds("secret = somethingwithoutanydigit")
    assert not kinds("123-45-6789") and kinds("ssn 123-45-6789") == [("ssn", "123-45-6789")]


def test_empty_and_very_long_texts(spark):
    rows = private_data.digest(private_data.spans(spark.createDataFrame([], "doc_id long, text string"))).collect()
    assert rows == []
    long = "word 12 " * 200_000 + "x@y.org " + "7" * 300_000 + " " + "a" * 300_000
    assert [s[0] for s in private_data.find_spans(long)] == ["email"]


def test_emails_by_run_are_finditer():
    rng = np.random.default_rng(1)
    for _ in range(4000):
        t = "".join(rng.choice(list("ab.@- é"), 24))
        assert list(private_data._emails(t)) == [m.span() for m in private_data._EMAIL.finditer(t)]
        t = "".join(rng.choice(list("12..3a"), 30))
        assert [m.span() for m in private_data._IP_RUNS.finditer(t)] == [m.span() for m in private_data._IP.finditer(t)]


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for bits in (1, 5, 8, 13, 16, 17, 20, 31, 32):
        ids = rng.integers(0, 2**bits, 1000, dtype=np.uint64)
        assert np.array_equal(token_output.unpack(token_output.pack(ids, bits), 1000, bits), ids)


def test_encode_is_the_librarys(spark):
    rng = np.random.default_rng(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(list("ab \n\t'\u00e9.1 \u00a0 s"), 30)) for _ in range(500)]
    texts += ["hello <|endoftext|> bye", "<|endoftext|><|endoftext|>", "a <|endof text|> b", "one word " * 200_000]
    for special in (True, False):
        tok = tokenizers.Tokenizer.from_file(PATH)
        if not special:
            tok.encode_special_tokens = True
        for some in (texts, texts[-4:-2], texts[:5]):
            ids, lengths = token_output.encode(PATH, pa.array(some, pa.large_string()), special)
            want = [tok.encode(t, add_special_tokens=False).ids for t in some]
            assert lengths.tolist() == [len(w) for w in want]
            assert ids.tolist() == [x for w in want for x in w]
    ids, _ = token_output.encode(PATH, pa.array(["hello <|endoftext|> bye"], pa.large_string()))
    assert ids.tolist() == [31373, 220, 50256, 33847]


def test_files_hold_every_document_in_order(spark, tmp_path):
    docs = docs_of(spark)
    files = token_output.write_tokens(docs, f"file://{tmp_path}/t", PATH, partitions=3)
    rows = sorted(token_output.read_tokens(spark, files).collect(), key=lambda r: r.start)
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    tok, at = tokenizers.Tokenizer.from_file(PATH), 0
    for r, (i, t) in zip(rows, order, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    reader = token_output.Reader(files[0][0])
    assert reader.document(0).tolist() == [*tok.encode(order[0][1] or "", add_special_tokens=False).ids, 2]
    assert token_output.token_output(docs.limit(0), PATH, folder=f"file://{tmp_path}/e").count() == 0


def test_mix_reaches_its_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'a' when id % 7 = 0 then null else 'b' end").alias("source"), F.expr("repeat('w ', cast(id % 97 as int))").alias("text"), F.lit(1).alias("target"))
    rows = mixing.copies(docs).collect()
    assert len(rows) == 3000
    total = sum(r["size"] for r in rows)
    taken = {}
    for r in rows:
        assert 0 <= r.copies <= 3
        taken.setdefault((r.source_size, r.target), []).append(r.copies * r["size"])
    assert sum(t for _, t in taken) == pytest.approx(total)
    for (_, target), got in taken.items():
        assert abs(sum(got) - target) < 400
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.copies(docs.limit(0)).count() == 0
    assert {r.copies for r in mixing.copies(docs_of(spark)).collect()} <= {0, 1, 2, 3}


def test_mix_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i + 1), "ab"[i % 2], i, "x") for i in range(12)], "doc_id long, text string, source string, VG_MIX int, copies string")
    out = mixing.mix(docs)
    rows = out.collect()
    assert out.columns == docs.columns and rows and all(r.VG_MIX == r.doc_id and r.copies == "x" for r in rows)


def test_batches_are_bounded_by_bytes_and_lose_no_row(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "1073741824")
        texts = spark.range(0, 600, 1, 1).select(F.when(F.col("id") == 300, F.repeat(F.lit("y"), 6 << 20)).otherwise(F.repeat(F.lit("x"), 40000)).alias("text"))
        found = map_batches(texts, sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 600 and len(found) >= 6
        assert max(r.size for r in found) < BATCH_BYTES + (6 << 20) + 100000
        assert spark.conf.get(key) == str(BATCH_BYTES)
        spark.conf.set(key, "65536")
        map_batches(texts, sizes, "n long, size long")
        assert spark.conf.get(key) == "65536"
    finally:
        spark.conf.set(key, before or str(BATCH_BYTES))


def test_small_groups_of_texts_are_encoded_as_all_at_once():
    tok = tokenizers.Tokenizer.from_file(PATH)
    texts = [f" word{k} and {k * k}" for k in range(150)]
    want = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    for at_once in (1, 64, 1000):
        assert [x.tolist() for x in token_output._ids(tok, texts, at_once)] == want
    assert token_output._ids(tok, []) == []


def test_batches_are_encoded_together(monkeypatch):
    """Pieces that several of Spark's batches hold are encoded once; batches are joined up to the bound, in order."""
    texts = ["the cat sat", None, "the cat sat on the mat", "", "x" * 50, "the end", "the cat"]
    batches = [pa.RecordBatch.from_arrays([pa.array([None if k == 3 else k], pa.int64()), pa.array([t], pa.string())], names=["doc_id", "text"]) for k, t in enumerate(texts)]
    (ids, all_texts), = token_output.joined(iter(batches))
    assert (ids.to_pylist(), all_texts.to_pylist()) == ([0, 1, 2, None, 4, 5, 6], [t or "" for t in texts])
    seen, encode = [], token_output._encode_pieces
    monkeypatch.setattr(token_output, "_encode_pieces", lambda path, special, pieces: seen.extend(pieces.to_pylist()) or encode(path, special, pieces))
    tok = tokenizers.Tokenizer.from_file(PATH)
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for dealt in (1, 3, 1 << 19):
        monkeypatch.setattr(token_output, "DEALT", dealt)
        got, lengths = token_output.encode(PATH, all_texts)
        assert (got.tolist(), lengths.tolist()) == (sum(want, []), [len(w) for w in want])
    assert len(seen) == 3 * len(set(seen))
    monkeypatch.setattr(token_output, "ENCODED_BYTES", 33)
    assert [t.to_pylist() for _, t in token_output.joined(iter(batches))] == [["the cat sat", "", "the cat sat on the mat", ""], ["x" * 50], ["the end", "the cat"]]
    assert list(token_output.joined(iter([]))) == []
