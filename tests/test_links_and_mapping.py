from pyspark.sql import functions as F

from verdigraph.operators import linking, mapping


def test_cascade_prefers_trust_then_compartment(spark):
    flows = spark.createDataFrame(
        [("u1", "Other", "air", None, None, "technosphere"), ("f1", "Carbon dioxide, fossil", "air/urban", "urban", "000124-38-9", "biosphere"), ("f2", "Carbon dioxide (fossil)", "water/river", "river", None, "biosphere"), ("f3", "Methane", "air", None, "74-82-8", "biosphere"), ("f4", "Lonely", "soil", None, None, "biosphere")],
        "flow_id string, name string, category string, sub string, cas string, kind string",
    )
    factors = spark.createDataFrame(
        [("m", 1, "u1", "x", None, "air", ""), ("m", 2, None, "y", "124-38-9", "air", ""), ("m", 3, None, "carbon dioxide fossil", None, "water", "river"), ("m", 4, None, "natural gas", None, "air", ""), ("m", 5, None, "nothing", None, None, None), ("m", 6, "f3", "carbon dioxide fossil", "124-38-9", "air", "")],
        "method string, cf_id int, flow_ref string, cf_name string, cas string, medium string, sub string",
    )
    synonyms = spark.createDataFrame([("natural gas", 1), ("methane", 1)], "norm_name string, gid int")
    found = mapping.match_factors(factors, flows, synonyms)
    assert sorted((r.cf_id, r.flow_id, r.strategy) for r in found.collect()) == [(1, "u1", "uuid"), (2, "f1", "cas"), (3, "f2", "name"), (4, "f3", "synonym"), (5, None, None), (6, "f3", "uuid")]
    s = mapping.statistics(found).first()
    assert (s.factors, s.matched, s.flows, s.by_uuid, s.by_cas, s.by_name, s.by_synonym) == (6, 5, 4, 2, 1, 1, 1)
    assert [r.cf_id for r in mapping.unmatched(found).collect()] == [5]
    assert [r.flow_id for r in mapping.uncharacterised(flows, found).collect()] == ["f4"]


def test_location_scores(spark):
    parents = {"FR": ["RER", "GLO"], "RER": ["GLO"], "CN": ["RAS", "GLO"], "XX": None, "GLO": []}
    cases = [("FR", "FR", 30), ("FR", "RER", 20), ("FR", "GLO", 20), ("XX", "GLO", 10), ("GLO", "FR", 0), ("FR", "CN", 5)]
    df = spark.createDataFrame([(a, b, parents[a], parents[b]) for a, b, _ in cases], "a string, b string, pa array<string>, pb array<string>")
    assert [r[0] for r in df.select(linking.location_score(F.col("a"), F.col("b"), F.col("pa"), F.col("pb"))).collect()] == [c[2] for c in cases]


def test_cross_links(spark):
    suppliers = spark.createDataFrame([("s1", "d", "Steel, hot", "kg", "RER"), ("s2", "d", "Steel, hot", "kg", "FR"), ("s3", "d", "Milk {FR}| mass", "t", "GLO"), ("s4", "d", "Power", "kWh", "CN")], "act_id string, db string, product string, unit string, location string")
    asked = spark.createDataFrame([("c", 1, "steel, HOT", "t", "FR"), ("c", 2, "Milk", "kg", "FR"), ("c", 3, "Power", "kg", "FR"), ("c", 4, "Nothing", "kg", "FR"), ("c", 5, "Milk {FR}| mass", "kg", "GLO"), ("c", 6, "Power", "MJ", "GLO")], "con string, seq int, product string, unit string, location string")
    dims = spark.createDataFrame([("kg", [1]), ("t", [1]), ("kWh", [0, 1]), ("MJ", [0, 1])], "unit string, dim array<int>")
    geo = spark.createDataFrame([("FR", ["RER", "GLO"]), ("RER", ["GLO"]), ("CN", ["GLO"])], "code string, parents array<string>")
    got = linking.cross_links(asked, suppliers, dims, geo)
    assert sorted((r.seq, r.supplier, r.score, r.blocker) for r in got.collect()) == [(1, "s2", 80, None), (2, "s3", 70, None), (3, None, None, "unit"), (4, None, None, "no_name"), (5, "s3", 80, None), (6, None, None, "location")]
    c = linking.completeness(got, asked).first()
    assert (c.inputs, c.resolved, c.percent) == (6, 3, 50.0)


def test_tiers(spark):
    suppliers = spark.createDataFrame([("a", 1, "Steel", "FR"), ("b", 2, "Steel", "DE"), ("c", 3, "Wood", "FR")], "act_id string, number int, name string, location string")
    asked = spark.createDataFrame([("x", 1, 1, "steel", "DE"), ("x", 2, 3, "steel", "DE"), ("x", 3, 9, "Steel", "ES"), ("x", 4, 1, "Stone", "FR")], "con string, seq int, number int, name string, location string")
    assert sorted((r.seq, r.supplier, r.tier) for r in linking.tiered_links(asked, suppliers).collect()) == [(1, "a", 1), (2, "b", 2), (3, "b", 3), (4, None, None)]
