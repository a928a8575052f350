import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from verdigraph.llm import decontamination, fingerprints, near_dedup, quality

WORDS = [f"w{i}" for i in range(400)]


def sets_by_contract(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_contract(docs):
    sets = [(i, sets_by_contract(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and docs[a][0] is not None and docs[b][0] is not None and (100 * len(x & y) >= 75 * len(x | y) or docs[a][0] == docs[b][0]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(s), None if i is None else (least[find(a)] if s else i)) for a, (i, s) in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=40))
    docs = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one  TWO"), (1005, "É é"), (1006, "one two three four"), (None, "one two"), (1007, "x " * 5000)]
    for g in range(12):
        base = rng.choices(WORDS, k=rng.choice([5, 8, 30, 120]))
        for _ in range(rng.choice([1, 2, 6, 14])):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else rng.choice(WORDS) for w in base]
            docs.append((len(docs) * 7 % 997, " ".join(copy).replace("w1", "W1")))
    for _ in range(40):  # a common passage, little else
        docs.append((len(docs) * 7 % 997, passage + " " + " ".join(rng.choices(WORDS, k=rng.choice([4, 8, 12, 20])))))
    return docs


def test_near_duplicates_are_those_of_a_full_comparison(spark):
    docs = corpus(1)
    rows = near_dedup.near_duplicates(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n int")).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=key) == sorted(components_by_contract(docs), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    twice = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "Q r s t u v"), (3, "z")]
    got = near_dedup.near_duplicates(spark.createDataFrame(twice, schema)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    kept = near_dedup.keep_one(spark.createDataFrame([*twice, (None, "q r s t u v")], schema)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 1, 3]


def test_long_words_that_differ_256_bytes_apart_are_different(spark):
    a = "k" + "m" * 255 + "k"
    b = chr(ord("k") + 3) + "m" * 255 + chr(ord("k") - 1)
    hashes, *_ = near_dedup.words_of(pa.array([a, b], pa.large_string()))
    assert hashes[0] != hashes[1]
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 100, 700))) for _ in range(300)]
    assert len({int(h) for h in near_dedup.words_of(pa.array(words, pa.large_string()))[0]}) == len(set(words))
    rows = near_dedup.near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 2)]


def test_large_classes_and_many_ids_take_their_own_ways(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", 3)
    monkeypatch.setattr(near_dedup, "IDS", 1)
    docs = corpus(2)
    docs += [(2000 + i, docs[20][1]) for i in range(9)] + [(2100 + i, "") for i in range(5)]
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=key) == sorted(components_by_contract(docs), key=key)


def test_clashing_columns_go_along(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "p", 0.5), (2, "a b c d e f", 6, "q", 0.1)], "doc_id long, text string, vg_kept_id int, vg_mix string, vg_score double")
    (row,) = near_dedup.keep_one(docs).collect()
    assert row.asDict() == {"doc_id": 1, "text": "a b c d e f", "vg_kept_id": 5, "vg_mix": "p", "vg_score": 0.5}


def test_prefix_pairs_are_complete(spark):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(rng.integers(0, 2**63, 60, dtype=np.uint64), 40)) for _ in range(4)]
    sets += [np.unique(np.concatenate([s[: len(s) - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for s in list(sets) for k in (0, 2, 4, 6)]
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, set binary")
    left = spark.createDataFrame([(i, i) for i in range(len(sets))], "id long, comp long")
    got = {(r.a, r.b) for r in near_dedup._prefix_pairs(df, left).collect()}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert (a, b) in got or 100 * len(x & y) < 75 * len(x | y)


def test_signatures_are_circulant_minhash():
    x = np.arange(1, 300, dtype=np.uint64)
    places = (near_dedup.mix64(x * near_dedup._SIGMA) >> np.uint64(32)).astype(np.uint32)
    for k in (0, 7, 224):
        shifted = (places.astype(np.uint64) + k).astype(np.uint32)
        assert near_dedup.signature(x)[k] == near_dedup._pi(shifted.copy()).min()
    same = np.mean(near_dedup.signature(x) == near_dedup.signature(x[:240]))
    assert abs(same - 240 / 299) < 0.12


def test_fingerprints(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([3, 40, 200]))) for _ in range(60)]
    docs = [(i * 3 % 61, t) for i, t in enumerate(texts)] + [(100, None), (101, texts[0]), (102, "é" * 7), (None, texts[1]), (101, texts[0])]
    rows = fingerprints.fingerprints(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, fp int")).collect()
    order = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n, after = len(t), order[(k + 1) % len(order)][1]
        edited = t[: n - n // 2] + after[: n // 2]
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in rows)
    by = {}
    for r in rows:
        t = dict(order)[r.doc_id]
        assert by.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.1
    assert fingerprints.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    lone = fingerprints.fingerprints(spark.createDataFrame([(1, "one two three")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hash_of(values):
    """Spark's xxhash64 of an array of whole numbers."""
    seed = 42
    for h in values:
        seed = xxhash.xxh64_intdigest((h % 2**64).to_bytes(8, "little"), seed)
    return signed(seed)


def fingerprints_by_definition(docs):
    """(fingerprint, edited fingerprint, near_edited, near_next) of each (doc_id, text), by plain loops."""
    terms = lambda t: sorted({signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w})
    order = sorted(docs)
    count, groups, likes = {}, {}, set()
    for _, t in order:
        own = terms(t)
        like = hash_of(own[: fingerprints.SKETCH])
        likes.add(like)
        for h in own:
            count[h] = count.get(h, 0) + 1
            groups.setdefault(h, set()).add(like)
    n = len(order)
    band = {h for h, c in count.items() if c > fingerprints.RAREST * n and (c <= max(fingerprints.COMMONEST * n, 2) or len(groups[h]) <= fingerprints.COMMONEST * len(likes))}

    def prints(t):
        own = terms(t) or ([signed(xxhash.xxh64_intdigest(t.encode(), 42))] if t else [])
        kept = [h for h in own if h in band] or own
        out = [hash_of(kept) if kept else 0]
        for c in fingerprints._patterns():
            for level in range(1, fingerprints.LEVELS + 1):
                some = [h for h in kept if ((h ^ c) & (2**level - 1)) == 0]
                out.append(hash_of(some) if some else 0)
        return out

    def like(a, b):
        weight = [2 ** ((k - 1) % fingerprints.LEVELS + 1 if k else 0) for k in range(len(a))]
        of = sum(w for w, x, y in zip(weight, a, b, strict=True) if x or y)
        return sum(w for w, x, y in zip(weight, a, b, strict=True) if x and x == y) / of if of else 1.0

    found = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % n][1]
        a, b, c = prints(t), prints(t[: len(t) - len(t) // 2] + after[: len(t) // 2]), prints(after)
        found[i] = (".".join(f"{x % 2**64:X}" for x in a), ".".join(f"{x % 2**64:X}" for x in b), like(a, b), like(a, c))
    return found


def test_fingerprints_are_those_of_their_definition(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BATCH", 64)  # more than one pass over the groups
    rng = random.Random(9)
    docs = [(i * 5 % 211, " ".join(rng.choices(WORDS[: rng.choice([30, 400])], k=rng.choice([0, 2, 30, 150])))) for i in range(150)]
    docs += [(300 + i, "n m o p " + " ".join(rng.choices(WORDS, k=2))) for i in range(60)] + [(400, " \t"), (401, ""), (402, "ÄÖ äö"), (403, "word " * 30000)]
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = fingerprints_by_definition(docs)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:2] == want[i][:2] and abs(got[i][2] - want[i][2]) < 1e-12 and abs(got[i][3] - want[i][3]) < 1e-12, i


def test_the_lexicon_has_rare_terms_and_no_others(spark):
    docs = [(i, f"zz yy u{i} " + " ".join(f"g{i // 4}x{k}" for k in range(6))) for i in range(2400)]
    rows = fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id % 4 < 3").collect()
    assert {r.near_next for r in rows} == {1.0}  # 4 of 2400 documents have each g-word; zz, yy and the u-words are out


def test_a_large_group_of_near_copies_stays_alike(spark):
    rng = random.Random(8)
    base = [f"h{k}" for k in range(60)]
    docs = [(i, " ".join(f"x{i}" if rng.random() < 0.03 else w for w in base)) for i in range(200)]
    docs += [(200 + i, " ".join(rng.choices(WORDS, k=40))) for i in range(300)]
    rows = fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id < 199").collect()
    assert np.mean([r.near_next for r in rows]) > 0.7
    # in every document each word is too common; a text without kept terms is still like a near copy
    same = [(i, " ".join(base) + (" zz" if i % 2 else "")) for i in range(40)]
    rows = fingerprints.fingerprints(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert min(r.near_next for r in rows) > 0.7


def leaky(rng):
    items = [" ".join(rng.choices(WORDS, k=k)) for k in (15, 30, 59, 100)]
    plain = [" ".join(rng.choices([f"v{i}" for i in range(300)] + WORDS[:60], k=rng.choice([20, 300]))) for _ in range(40)]
    out = list(enumerate(plain))
    truth = set()
    for k, item in enumerate(items):
        words = item.split()
        loose = [w if j % 8 else "other" for j, w in enumerate(words)]
        for form in (item, item.upper().replace(" ", "!! "), " ".join(loose)):
            out.append((100 + len(out), plain[k] + " " + form + " " + plain[k + 9]))
            truth.add((out[-1][0], k))
    return items, out, truth


def test_leaks_are_found_and_clean_documents_stay(spark):
    items, docs, truth = leaky(random.Random(9))
    docs += [(500, None), (501, ""), (None, items[0]), (None, items[0])]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = decontamination.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth | {(None, 0)} and len(got) == len(truth) + 1
    left = decontamination.clean(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [*range(40), 500, 501]
    assert decontamination.clean(df, bench.limit(0)).count() == len(docs) and decontamination.leaks(df.limit(0), bench).count() == 0


def test_recall_and_candidates_of_a_full_block(spark):
    rng = np.random.default_rng(11)
    share = 1 / (np.arange(6000) + 8.0)
    draw = lambda k: [f"t{i}" for i in rng.choice(6000, k, p=share / share.sum())]
    items = [draw(int(rng.integers(20, 60))) for _ in range(decontamination.PASSAGES)]

    def swapped(words):
        parts = [words[k : k + 4] for k in range(0, len(words), 4)]
        for k in range(0, len(parts) - 1, 2):
            parts[k], parts[k + 1] = parts[k + 1], parts[k]
        return [w for p in parts for w in p]

    forms = {
        "whole": lambda w: w, "fourth": lambda w: [x if k % 4 else draw(1)[0] for k, x in enumerate(w)],
        "third": lambda w: [x if k % 3 else draw(1)[0] for k, x in enumerate(w)], "swapped": swapped,
    }
    docs, truth = [(i, " ".join(draw(300))) for i in range(60)], {}
    for name, form in forms.items():
        for _ in range(40):
            k = int(rng.integers(len(items)))
            truth[len(docs)] = (name, k)
            docs.append((len(docs), " ".join(draw(int(rng.integers(0, 200))) + form(items[k]) + draw(int(rng.integers(0, 200))))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    (group,) = decontamination.prepare(df, bench)
    tally = [0]
    found = {(d, i) for d, i, *_ in decontamination.search(group, pa.array([t for _, t in docs], pa.large_string()), tally)}
    for name in forms:
        own = {(d, k) for d, (n, k) in truth.items() if n == name}
        assert len(own & found) >= (0.75 if name == "third" else 0.9) * len(own), (name, len(own & found))
    assert not {d for d, _ in found} & set(range(60)), "clean documents"
    assert tally[0] < 20 * len(docs)


def test_blocks_and_groups_share_the_search(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASSAGES", 2)
    monkeypatch.setattr(decontamination, "GROUP", 2)
    items, docs, truth = leaky(random.Random(9))
    rng = random.Random(10)
    items.append(" ".join(rng.choices([f"long{i}" for i in range(900)], k=1000)))  # over many blocks
    docs += [(700, "v1 v2 " + items[4]), (701, " ".join(items[4].split()[300:420]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert [len(g.queries) for g in decontamination.prepare(df, bench)] == [2] * 5 + [1]
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()}
    assert got == truth | {(700, 4), (701, 4)}
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == set(range(40))


def test_common_weight_is_the_heaviest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b, w = rng.integers(0, 6, 9), rng.integers(0, 6, 12), rng.random(6).astype(np.float32)
        best = np.zeros((10, 13))
        for i in range(9):
            for j in range(12):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (w[a[i]] if a[i] == b[j] else -9))
        assert abs(decontamination.common_weight(a, b, w) - best[-1, -1]) < 1e-4


def test_quality_learns_from_held_in_rows_only(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choices(WORDS, k=rng.choice([20, 200]))) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=rng.choice([20, 200]))) for _ in range(60)]
    rows = [(i, t, 0) for i, t in enumerate(good + bad)] + [(None, None, 0), (900, "", 0), (0, good[0], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(900, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 210]
    assert len(held) > 40 and np.mean([r.predicted == int(r.doc_id < 150) for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, begin = quality.passages(pa.array(["a b c " * 40, "X!! y", "", "one two three four"], pa.large_string()))
    assert begin.tolist() == [0, 3, 4, 5, 6] and x.shape == (6, quality.INPUTS)
    x = x + rng.normal(0, 0.1, x.shape)
    label, weight = np.array([1.0, 0, 0, 1]), np.array([0.1, 0.4, 0.3, 0.2])
    model = quality.start(x)
    model.w = [np.asarray(w + rng.normal(0, 0.3, w.shape)) for w in model.w]
    for k, g in enumerate(quality.gradients(model, x, begin, label, weight)):
        for place in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(5)]:
            was, both = model.w[k][place], []
            for step in (1e-5, -1e-5):
                w = model.w[k].copy()
                w[place] = was + step  # place is () for the last one
                both.append(quality.loss(quality.Model(model.mean, model.scale, [*model.w[:k], w, *model.w[k + 1 :]]), x, begin, label, weight))
            assert abs((both[0] - both[1]) / 2e-5 - g[place]) < 1e-6


def test_the_encoder_sees_words():
    """Labels that follow one word of a passage among many, with the same characters all over."""
    rng = random.Random(12)
    texts, label = [], []
    for k in range(600):
        words = ["".join(rng.sample("abcdefgh", 5)) for _ in range(rng.choice([30, 150]))]
        label.append(k % 2)
        texts.append(" ".join(words[:10] + (["abcde"] if k % 2 else ["edcba"]) * 6 + words[10:]))
    x, begin = quality.passages(pa.array(texts, pa.large_string()))
    cut = int(begin[400])
    model = quality.train(x[:cut], begin[:401], np.array(label[:400], np.float32))
    right = (model.score(x[cut:], begin[400:] - cut) >= 0.5) == (np.array(label[400:]) == 1)
    assert right.mean() >= 0.9


def test_quality_of_ties_and_a_very_long_text():
    long = "some good words here . " * 100_000
    x, begin = quality.passages(pa.array([long, long, "", "a"], pa.large_string()))
    assert begin[1] == -(-500_000 // quality.PASSAGE) and np.isfinite(x).all()
    model = quality.train(x[:50], np.array([0, 25, 50]), np.array([1.0, 0.0], np.float32), steps=3)
    scores = model.score(x, begin)
    assert abs(scores[0] - scores[1]) < 1e-6 and np.isfinite(scores).all()


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    items, docs, truth = leaky(rng)
    docs = [(i, t + ".", "en", rng.choice(["a", "b", None]), len(t)) for i, t in docs]
    bad = [(2000 + i, " ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=60)), "en", "a", 0) for i in range(40)]
    near = [(3000, docs[1][1] + " x", "en", "a", 0)]
    tables = {
        "documents": spark.createDataFrame(docs + bad + near, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": spark.createDataFrame(list(enumerate(items)), "item_id long, text string"),
        "labels": spark.createDataFrame([(d[0], 1, 0) for d in docs] + [(d[0], 0, 0) for d in bad], "doc_id long, quality int, toxic int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == tables["documents"].columns
        seen.append({r.doc_id for r in now.collect()})
    assert not seen[0] & {d[0] for d in bad} and len(seen[0] & {d[0] for d in docs}) >= 0.95 * len(docs)
    assert 3000 not in seen[1] and 1 in seen[1]
    assert not seen[2] & {d for d, _ in truth} and seen[2] >= seen[1] - {d for d, _ in truth}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == seen[3] and all(r.n_tokens > 1 for r in out)
