import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigraph.functions import units
from verdigraph.operators import graph, impact, matrix, search

SCHEMA = "act_id string, seq int, kind string, flow_id string, amount double, unit string, is_input boolean, is_reference boolean, link string"


def chain(spark):
    rows = [
        ("X", 0, "technosphere", "X", 1.0, "kg", False, True, None), ("X", 1, "technosphere", "Y", 0.6, "kg", True, False, "Y"),
        ("Y", 0, "technosphere", "Y", 1.0, "kg", False, True, None), ("Y", 1, "technosphere", "Z", 0.4, "kg", True, False, "Z"),
        ("Z", 0, "technosphere", "Z", 1.0, "kg", False, True, None), ("Z", 1, "biosphere", "co2", 4.0, "kg", False, False, None), ("Z", 2, "biosphere", "zinc", 0.003, "kg", False, False, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def test_chain_of_three(spark):
    e = chain(spark)
    tech, bio = matrix.technosphere(e), matrix.biosphere(e)
    for scaling in (matrix.solve_levels(roots(spark, "X"), tech, 3), matrix.solve_blocks(roots(spark, "X"), tech)):
        assert {r.act_id: r.x for r in scaling.collect()} == pytest.approx({"X": 1.0, "Y": 0.6, "Z": 0.24}, abs=1e-10)
        inv = matrix.inventory(bio, scaling)
        assert {r.flow_id: r.q for r in inv.collect()} == pytest.approx({"co2": 0.96, "zinc": 0.00072}, abs=1e-10)
    flows = spark.createDataFrame([("co2", "kg"), ("zinc", "kg")], "flow_id string, unit string")
    factors = spark.createDataFrame([("gwp", "co2", 1.0, "kg"), ("g", "co2", 1.0, "g"), ("odd", "co2", 2.0, "m3")], "method string, flow_id string, cf double, cf_unit string")
    w = impact.effective_factors(flows, factors, units.from_rows(spark))
    assert {r.method: (round(r.weight, 9), r.conversion_failed) for r in w.collect()} == {"gwp": (1.0, False), "g": (1000.0, False), "odd": (2.0, True)}
    assert {r.method: r.score for r in impact.scores(inv, w).collect()} == pytest.approx({"gwp": 0.96, "g": 960.0, "odd": 1.92})
    assert {r.act_id for r in impact.activity_contributions(bio, scaling, w).where("method = 'gwp'").collect()} == {"Z"}
    p = graph.paths(roots(spark, "X"), tech, spark.createDataFrame([("Z",)], "act_id string"), 4).first()
    assert (p.path, p.steps, round(p.ratio, 9)) == ("X Y Z", 2, 0.24)


def test_self_loop_changes_the_norm(spark):
    e = spark.createDataFrame([("A", 0, "technosphere", "A", 1.0, "kg", False, True, None), ("A", 1, "technosphere", "A", 0.1, "kg", True, False, "A"), ("A", 2, "technosphere", "B", 0.8, "kg", True, False, "B"), ("B", 0, "technosphere", "B", 1.0, "kg", False, True, None)], SCHEMA)
    assert {r.act_id: r.norm for r in matrix.norm_factors(e).collect()} == pytest.approx({"A": 0.9, "B": 1.0})
    assert {(r["sup"], r["con"]): r.v for r in matrix.technosphere(e).collect()} == pytest.approx({("B", "A"): 0.8 / 0.9})


def test_loops_solve_exactly(spark):
    rng = np.random.default_rng(0)
    n = 12
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.3) * 0.4
    np.fill_diagonal(a, 0)
    a[3, 4], a[4, 3] = 1.5, 0.9  # diverges by sweeps
    tech = spark.createDataFrame([(f"a{i}", f"a{j}", float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "sup string, con string, v double")
    found = matrix.solve_blocks(roots(spark, "a0", "a3", "lonely"), tech).collect()
    for k in (0, 3):
        want = np.linalg.solve(np.eye(n) - a, np.eye(n)[k])
        got = {r.act_id: r.x for r in found if r.root == f"a{k}"}
        assert [got.get(f"a{i}", 0.0) for i in range(n)] == pytest.approx(want.tolist(), abs=1e-8)
    assert [(r.act_id, r.x) for r in found if r.root == "lonely"] == [("lonely", 1.0)]


def test_substitution(spark):
    e = chain(spark)
    tech = matrix.technosphere(e)
    none = spark.createDataFrame([], "con string, old string, new string")
    same = spark.createDataFrame([("X", "Y", "Y")], none.schema)
    base = {(r["sup"], r["con"]): r.v for r in tech.collect()}
    assert {(r["sup"], r["con"]): r.v for r in matrix.substitute(tech, none).collect()} == base
    assert {(r["sup"], r["con"]): r.v for r in matrix.substitute(tech, same).collect()} == pytest.approx(base)
    swap = matrix.substitute(tech, spark.createDataFrame([("X", "Y", "Z")], none.schema))
    x = {r.act_id: r.x for r in matrix.solve_levels(roots(spark, "X"), swap, 3).collect()}
    assert x == pytest.approx({"X": 1.0, "Z": 0.6})


def test_bm25_and_fuzzy(spark):
    docs = spark.createDataFrame([(1, "steak haché cru"), (2, "lait demi-écrémé"), (3, "electricity grid FR")], "doc int, text string")
    postings, lengths = search.index(docs)
    terms = spark.createDataFrame([("q", "steak", 1.0), ("q", "hache", 1.0)], "query string, term string, weight double")
    got = search.bm25(postings, lengths, terms, search.document_statistics(docs, lengths)).collect()
    assert [r.doc for r in got] == [1] and got[0].score == pytest.approx(2 * np.log(2.5 / 1.5 + 1) * 2.2 / 2.2, rel=1e-6)
    vocabulary = postings.select("term").distinct()
    q = spark.createDataFrame([("typo", "electrcity"), ("stem", "electri"), ("both", "lait grid")], "query string, text string")
    found = {(r["query"], r.term): r.weight for r in search.expand(q, vocabulary).collect()}
    assert found[("typo", "electricity")] == 0.5 and found[("stem", "electricity")] == 0.7 and found[("both", "lait")] == 1.0
    assert search.all_tokens(search.expand(q, vocabulary), q, postings).where(F.col("query") == "both").count() == 0
