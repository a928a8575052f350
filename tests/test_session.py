import json

import pytest
from pyspark.sql import functions as F

from verdigraph.functions import show, units
from verdigraph.functions.scoring import ScoringSet
from verdigraph.operators import lookups, matrix, multidb, paging, scoring, search, synonyms, tree
from verdigraph.plans import dependencies, session
from verdigraph.sources import dispatch, reference

ROWS = "act_id string, seq int, kind string, flow_id string, amount double, unit string, is_input boolean, is_reference boolean, link string"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_linked_databases_by_hand(spark):
    edges, links, none = "sup string, con string, v double", "con string, source_db string, sup string, v double", []
    a = multidb.Database(table(spark, [("a2", "a1", 0.5)], edges), table(spark, [("co2", "a2", 1.0)], "flow_id string, act_id string, v double"), table(spark, [("a1", "b", "b1", 2.0), ("a2", "b", "b1", 1.0), ("a2", "lost", "x", 9.0)], links), 1)
    b = multidb.Database(table(spark, [("b2", "b1", 0.1)], edges), table(spark, [("co2", "b2", 10.0)], "flow_id string, act_id string, v double"), table(spark, none, links), 1)
    found = {"a": a, "b": b}
    demand = table(spark, [("r", "a1", 1.0)], "root string, act_id string, amount double")
    scaling = multidb.solve(found, "a", demand)
    assert {(r.db, r.act_id): round(r.x, 9) for r in scaling.collect()} == {("a", "a1"): 1.0, ("a", "a2"): 0.5, ("b", "b1"): 2.5, ("b", "b2"): 0.25}
    assert multidb.inventory(found, scaling).first().q == pytest.approx(0.5 + 2.5)
    assert multidb.reachable(found, "a") == {"a", "b", "lost"} and multidb.reachable(found, "b") == {"b"}
    change = "con_db string, con string, old_db string, old string, new_db string, new string"
    moved = multidb.rewire(found, "a", table(spark, [("a", "a1", "a", "a2", "b", "b2"), ("a", "a2", "b", "b1", "a", "a9")], change))
    assert {(r.db, r.act_id): round(r.x, 9) for r in multidb.solve(moved, "a", demand).collect()} == {("a", "a1"): 1.0, ("b", "b1"): 2.0, ("b", "b2"): 0.7}
    with pytest.raises(ValueError, match="does not reach"):
        multidb.rewire(found, "b", table(spark, [("a", "a1", "a", "a2", "b", "b2")], change))
    asked = table(spark, [("r", "b1", 500.0, "g"), ("r", "zz", 1.0, "kg"), ("r", "b1", 1.0, "KG ")], "root string, sup string, amount double, unit string")
    made = table(spark, [("b1", "kg")], "act_id string, unit string")
    assert [(r.act_id, r.amount) for r in multidb.demand_of(asked, made, units.from_rows(spark)).collect()] == [("b1", 1.5)]
    with pytest.raises(Exception, match="no conversion"):
        multidb.demand_of(asked.withColumn("unit", F.lit("m")), made, units.from_rows(spark)).collect()


def test_rules_are_their_changes(spark):
    edges = [("a", "p1", "b", "s1", 0.5), ("a", "p1", "b", "s2", 0.25), ("a", "p2", "b", "s2", 1.0), ("b", "s1", "b", "n", 2.0), ("b", "n", "b", "r", 0.5), ("b", "n", "b", "q", -0.5)]
    found = table(spark, edges, "con_db string, con string, sup_db string, sup string, v double")
    moved = multidb.redirect(found, [("con like 'p%'", "b", "s1"), ("con = 'n' or con = 'p2'", "elsewhere", "p1")])
    assert sorted(map(tuple, moved.collect())) == [("a", "p1", "b", "s1", 0.75), ("a", "p2", "b", "s1", 1.0), ("b", "s1", "b", "n", 2.0)]
    own = found.where("con_db = sup_db").select("sup", "con", "v")
    a = multidb.Database(own.where("false"), own, found.where("con_db = 'a'").selectExpr("con", "sup_db as source_db", "sup", "v"), 0)
    b = multidb.Database(own, own, found.where("false").selectExpr("con", "sup_db as source_db", "sup", "v"), 2)
    changes = [(d, c, e, s, "b", "s1") if d == "a" else (d, c, e, s, "elsewhere", "p1") for d, c, e, s, _ in edges if c != "s1"]
    want = multidb.rewire({"a": a, "b": b}, "a", table(spark, changes, "con_db string, con string, old_db string, old string, new_db string, new string"))
    assert sorted(map(tuple, want["a"].links.collect())) == [("p1", "b", "s1", 0.75), ("p2", "b", "s1", 1.0)]
    assert (want["b"].tech.collect(), want["b"].links.count()) == ([("n", "s1", 2.0)], 0)


def test_technosphere_converts_units_or_fails(spark):
    rows = [("A", 0, "technosphere", "A", 1.0, "kg", False, True, None), ("A", 1, "technosphere", "B", 500.0, "g", True, False, "B"), ("B", 0, "technosphere", "B", 2.0, "kg", False, True, None)]
    e = table(spark, rows, ROWS)
    assert [tuple(r) for r in matrix.technosphere(e, units.from_rows(spark)).collect()] == [("B", "A", 0.5)]
    with pytest.raises(Exception, match="no conversion from m to kg for A"):
        matrix.technosphere(e.withColumn("unit", F.when(F.col("is_input"), "m").otherwise(F.col("unit"))), units.from_rows(spark)).collect()


def test_transposed_solution_is_the_solution(spark):
    tech = table(spark, [("b", "a", 0.5), ("c", "a", 0.25), ("c", "b", 2.0)], "sup string, con string, v double")
    seed = table(spark, [("c", "k", 3.0), ("a", "k", 1.0)], "act_id string, key string, w double")
    assert {r.act_id: r.y for r in matrix.intensities(seed, tech, 2).collect()} == {"a": 1 + 0.25 * 3 + 0.5 * 2 * 3, "b": 6.0, "c": 3.0}


def test_trees_cut_loops_and_keep_a_budget(spark):
    inputs = table(spark, [("a", 1, "b", 1.0), ("a", 2, "c", 2.0), ("b", 1, "a", 3.0), ("b", 2, "c", 4.0), ("c", 1, "d", 5.0)], "act_id string, seq int, link string, amount double")
    roots = table(spark, [("a",)], "root string")
    got = [(r.place, r.parent, r.act_id, r.amount, r.depth, r.loop) for r in tree.expand(roots, inputs, 3).orderBy("place").collect()]
    assert got == [(1, None, "a", 1.0, 0, False), (2, "a", "b", 1.0, 1, False), (3, "b", "a", 3.0, 2, True), (4, "b", "c", 4.0, 2, False), (5, "c", "d", 5.0, 3, False), (6, "a", "c", 2.0, 1, False), (7, "c", "d", 5.0, 2, False)]
    few = tree.expand(roots, inputs, 3, budget=4)
    assert [r.act_id for r in few.orderBy("place").collect()] == ["a", "b", "a", "c"]
    assert tuple(tree.summary(few).first()) == ("a", 4, 3, 1, 2)
    kinds = {(r.source, r.target): (r.amount, r.kind) for r in tree.edges(few).collect()}
    assert kinds == {("a", "b"): (1.0, "supply"), ("b", "a"): (3.0, "loop"), ("b", "c"): (4.0, "supply")}


def test_pages_and_lookups(spark):
    rows = table(spark, [(i, f"n{i % 3}") for i in range(10)], "id int, name string")
    got = paging.page(rows, "name", "id", descending=True, offset=2, limit=3).collect()
    assert [(r.id, r.total, r.has_more) for r in got] == [(8, 10, True), (1, 10, True), (4, 10, True)]
    assert paging.page(rows, "id", "id", offset=-1).count() == 10 and paging.page(rows.limit(0), "id", "id", limit=5).count() == 0
    flows = table(spark, [("f1", "Sulphur dioxide", ["SO2"]), ("f2", "Water", None)], "flow_id string, name string, synonyms array<string>")
    assert [r.flow_id for r in lookups.flow_search(flows, "so2").collect()] == ["f1"] and lookups.flow_search(flows, " ").count() == 0
    pairs = table(spark, [("CO2", "Carbon dioxide"), ("carbonic gas", "carbon dioxide")], "a string, b string")
    groups = synonyms.star_groups(pairs)
    assert {r.member for r in synonyms.lookup(table(spark, [("co2",)], "name string"), groups).collect()} == {"carbon dioxide", "carbonic gas"}
    assert synonyms.compile_groups([["a", "b"], ["x"]], [("b", "c"), ("d", "e"), ("c", "d")], most=4) == [["a", "b", "c"], ["d", "e"]]
    known = table(spark, [("f", "Ethanol", "64-17-5", ["Alcohol"]), ("g", "Ethyl alcohol", "000064-17-5", None)], "flow_id string, name string, cas string, synonyms array<string>")
    assert {tuple(r) for r in synonyms.extract(known).collect()} == {("Ethanol", "Alcohol"), ("Ethanol", "Ethyl alcohol")}


def test_search_of_activities(spark):
    activities = table(spark, [("a", "steel making", "DE"), ("b", "wheat growing", "FR"), ("c", "steel rolling", "FR")], "act_id string, name string, location string")
    products = table(spark, [("a", "Steel Slab"), ("b", "wheat grain"), ("c", "sheet")], "act_id string, product_name string")
    docs = search.activity_documents(activities, products)
    found = search.ranked(table(spark, [("q", "steal slab")], "query string, text string"), docs).orderBy(F.col("score").desc()).collect()
    assert found[0].doc == "a" and {r.doc for r in found} <= {"a", "c"}
    words = search.product_words(products)
    assert [r.act_id for r in search.makers(words, "SLA ste").collect()] == ["a"] and search.makers(words, " ").count() == 0


def test_factors_at_scoring_time(spark):
    flows = table(spark, [("f1", "Methane", "air/urban", "urban"), ("f2", "Methane", "air", None), ("f3", "Coal", "natural resource", None), ("f4", "None", "soil", None)], "flow_id string, name string, category string, sub string")
    matches = [("m", "f1", "Methane", "air", "", 1.0, "uuid"), ("m", None, "methane", "air", "", 5.0, "name"), ("m", None, "Methane", "air", "", 4.0, "cas"), ("m", None, "coal", "resource", "in ground", 7.0, "name")]
    got = scoring.lookup(flows, table(spark, matches, "method string, flow_id string, cf_name string, medium string, sub string, cf double, strategy string"))
    assert {r.flow_id: (r.cf, r.level) for r in got.collect()} == {"f1": (1.0, 1), "f2": (1.0, 2), "f3": (7.0, 3)}
    scores = table(spark, [("r", "gwp", 8.0), ("r", "ap", 2.0), ("s", "ap", 1.0)], "root string, method string, score double")
    chosen = ScoringSet("one", {"g": "gwp", "a": "ap"}, {"total": "g + a"}, normalization={"g": 2.0}, weighting={"g": 0.5, "a": 3.0})
    assert {(r.root, r.name, r.kind): r.value for r in scoring.sets(scores, [chosen]).collect()} == {("r", "total", "score"): 8.0, ("r", "g", "indicator"): 2.0, ("r", "a", "indicator"): 6.0}
    asked = table(spark, [("r",), ("zz",), (" ",)], "asked string")
    out = {(r.asked, r.method): r.outcome for r in scoring.batch(asked, table(spark, [("r",), ("s",)], "root string"), scores).collect()}
    assert out == {("r", "gwp"): "found", ("r", "ap"): "found", ("zz", None): "not_found", (" ", None): "invalid"}
    hot = scoring.hotspots(table(spark, [("r", "m", "a", 3.0), ("r", "m", "b", -9.0), ("r", "m", "c", 8.0)], "root string, method string, act_id string, contribution double"), 2)
    assert [(r.act_id, r.share) for r in hot.orderBy("place").collect()] == [("b", -450.0), ("c", 400.0)]


def test_a_session(spark, tmp_path):
    linked = table(spark, [("a", 0, "technosphere", "a", 1.0, "kg", False, True, None), ("a", 1, "technosphere", "b", 1.0, "kg", True, False, "b")], ROWS)
    loose = linked.withColumn("link", F.lit(None).cast("string"))
    s, reads = session.Session(spark), []

    def reader(name, rows):
        return lambda: reads.append(name) or rows

    s.entries = {"base": session.Entry(reader("base", linked), cache=f"file://{tmp_path}/base"), "top": session.Entry(reader("top", loose), ("base",), (lambda d: d.where("seq >= 0"),))}
    assert s.load("top") == ["base", "top"] and s.load("top") == []
    with pytest.raises(dependencies.DependencyError, match="needed by top"):
        s.unload("base")
    assert {r.name: r.status for r in s.status().collect()} == {"base": "loaded", "top": "partially_linked"}
    s.relink("top", lambda rows, need: rows.withColumn("link", F.when(F.col("is_input"), F.lit("b"))))
    assert {r.status for r in s.status().collect()} == {"loaded"}
    s.unload("top"), s.unload("base"), s.load("base")
    assert reads == ["base", "top"] and s.loaded["base"].count() == 2  # the second time from its cache
    s.stage("new", loose)
    s.add_need("new", "base"), s.drop_need("new", "base"), s.add_need("new", "base")
    with pytest.raises(session.NotLinked, match="1 inputs"):
        s.finalize("new")
    s.stage("none", linked.limit(0))
    with pytest.raises(ValueError, match="no activities"):
        s.finalize("none")
    s.stage("new", linked, ("base",))
    s.finalize("new")
    assert "new" in s.loaded and {r.name: r.status for r in s.status().collect()}["none"] == "staged"
    s.add_methods("ef", table(spark, [("gwp", "x", 1.0)], "method string, flow_id string, cf double"))
    made = []
    for _ in range(2):
        s.mapping("new", "ef", lambda d, f: made.append(1) or d)
    assert len(made) == 1 and [tuple(r) for r in s.method_list().collect()] == [("ef", "gwp", 1)]
    s.drop_methods("ef")
    assert s.method_list().count() == 0 and not s.tables
    s.set_reference("units", "one", table(spark, [("kg", 1.0), ("t", 9.0)], "name string, factor double"))
    s.set_reference("units", "two", table(spark, [("t", 1000.0)], "name string, factor double"))
    assert {r.name: r.factor for r in s.merged_reference("units", ["name"]).collect()} == {"kg": 1.0, "t": 1000.0}
    assert session.load(spark, f"file://{tmp_path}/nothing") is None


def test_reference_data_and_config(spark, tmp_path):
    places = tmp_path / "geo.csv"
    places.write_text("code,name,parents\nFR,France,RER|GLO\nCN-SGCC,State Grid, China,CN|GLO\nGLO,Global,\n")
    assert {r.code: (r.display, r.parents) for r in reference.geographies(spark, str(places)).collect()} == {"FR": ("France", ["RER", "GLO"]), "CN-SGCC": ("State Grid, China", ["CN", "GLO"]), "GLO": ("Global", [])}
    rows = table(spark, [("Air", "Urban"), ("soil", "")], "medium string, sub string")
    assert {tuple(r) for r in reference.mapped(rows, reference.compartments(spark, "medium,sub,q,m,s,q\nair,urban,,air,high. pop.,")).collect()} == {("air", "high. pop."), ("soil", "")}
    pairs = tmp_path / "pairs.csv"
    pairs.write_text('name,synonym\n"a, b",c\n')
    found = reference.synonym_pairs(spark, str(pairs))
    assert [tuple(r) for r in found.collect()] == [("a, b", "c")] and [r.value for r in reference.pairs_csv(found).collect()] == ['"a, b",c']
    config = tmp_path / "c.toml"
    reference.write_config(config, {"databases": [{"name": "x", "path": "x dir", "depends": []}, {"name": "y", "path": "y", "depends": ["x"]}], "classification-presets": [{"name": "p", "filters": [{"system": "s", "value": 'v"'}, {"system": "t", "value": "w", "mode": "contains"}]}]})
    got = reference.load_config(config)
    assert got.databases[0]["path"] == str(tmp_path / "x dir") and got.presets == {"p": [("s", 'v"', True), ("t", "w", False)]}
    reference.write_config(config, {"databases": [{"name": "y", "path": "y", "depends": ["zz"]}]})
    with pytest.raises(ValueError, match="depends on zz"):
        reference.load_config(config)


def test_any_folder_and_showing(spark, tmp_path):
    from test_formats import CSV, ES1

    (tmp_path / "one").mkdir(), (tmp_path / "two").mkdir(), (tmp_path / "three").mkdir()
    (tmp_path / "one/a.xml").write_text(ES1.replace("http://x/01", "http://www.EcoInvent.org/EcoSpold01"))
    (tmp_path / "two/d.csv").write_text(CSV)
    kinds = {}
    for name in ("one", "two"):
        kind, rows = dispatch.read(spark, str(tmp_path / name))
        kinds[name] = kind
        assert rows.columns == list(dispatch.COLUMNS) and rows.count() > 3
    assert kinds == {"one": "ecospold1", "two": "simapro"}
    with pytest.raises(ValueError, match="no process data"):
        dispatch.read(spark, str(tmp_path / "three"))
    both = dispatch.flows(rows, rows)
    assert both.count() == rows.select("flow_id").distinct().count()
    assert show.render({"n": 1, "rows": [{"a": "x,y", "b": None}]}, "csv") == 'a,b\n"x,y",\n' and show.render([{"a": 1}], "table").split("\n") == ["a", "-", "1"]
    assert json.loads(show.render({"a": 1}, "csv")) == {"a": 1} and show.strategy_of("ByCAS") == "cas" and show.strategy_of("?") == "fuzzy" and show.strategy_text("name") == "ByName"
    assert show.size_text(1536) == "1.5 KB" and show.time_text(0.85) == "850 ms" and show.time_text(125) == "2 min 5 s" and show.entities("a &amp; b") == "a & b"
