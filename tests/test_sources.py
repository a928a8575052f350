import pytest

from verdigraph.operators import export, matrix
from verdigraph.sources import ecospold2, tables

ACT = {n: f"{n * 8}-0000-4000-8000-000000000000" for n in "abd"}


def spold(name, exchanges, location="FR"):
    geo = f"<geography><shortname>{location}</shortname></geography>" if location else ""
    return f"""<?xml version="1.0"?><ecoSpold xmlns="http://www.EcoInvent.org/EcoSpold02"><childActivityDataset><activityDescription><activity><activityName>{name}</activityName></activity>{geo}</activityDescription><flowData>{exchanges}</flowData></childActivityDataset></ecoSpold>"""


def tech(flow, amount, group, link=None, kind="output"):
    act = f' activityLinkId="{ACT[link]}"' if link else ""
    return f'<intermediateExchange intermediateExchangeId="{flow}" amount="{amount}"{act}><name>product {flow}</name><unitName>kg</unitName><property><name>dry mass</name></property><synonym>syn {flow}</synonym><{kind}Group>{group}</{kind}Group></intermediateExchange>'


CO2 = '<elementaryExchange elementaryExchangeId="co2" amount="4.0" casNumber="000124-38-9"><name>Carbon dioxide</name><unitName>kg</unitName><compartment><compartment>air</compartment><subcompartment>urban</subcompartment></compartment><outputGroup>4</outputGroup></elementaryExchange>'
ORE = '<elementaryExchange elementaryExchangeId="ore" amount="1"><name>Ore</name><compartment><compartment>natural resource</compartment></compartment></elementaryExchange>'


@pytest.fixture
def files(tmp_path):
    texts = {
        f"{ACT['a']}_{ACT['a']}": spold("make X", tech("x", 1, 0) + tech("y", 0.6, 5, "b", "input")),
        f"{ACT['b']}_{ACT['b']}": spold("make Y", tech("y", 1, 2) + tech("w", 0, 2) + tech("z", 0.4, 5, "d", "input"), None),
        f"{ACT['d']}_{ACT['d']}": spold("make Z", tech("z", 1, 0) + CO2 + ORE),
        "twoouts_p": spold("none", tech("q", 1, 2) + tech("r", 2, 2)),
        "broken_p": "<ecoSpold><oops>",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.spold").write_text(text)
    (tmp_path / "readme.txt").write_text("no data")
    return str(tmp_path)


def test_files_become_a_database(spark, files):
    raw = ecospold2.read(spark, files)
    rows = ecospold2.cut_off(raw)
    assert {r.act_id[0] for r in rows.select("act_id").distinct().collect()} == {"a", "b", "d"}
    assert ecospold2.rejected(raw).count() == 2 and raw.where("error is not null").count() == 1
    got = {(r.act_id[0], r.flow_id): r for r in rows.collect()}
    assert got["b", "y"].is_reference and ("b", "w") not in got and got["b", "y"].act_location == "GLO"
    assert (got["d", "co2"].category, got["d", "co2"].is_input, got["d", "ore"].is_input, got["d", "ore"].unit) == ("air/urban", False, True, "UNKNOWN_UNIT")
    assert got["a", "y"].flow_name == "product y" and got["a", "y"].link == ACT["b"]
    x = matrix.solve_levels(spark.createDataFrame([(ACT["a"],)], "root string"), matrix.technosphere(rows), 3)
    assert {r.act_id[0]: r.x for r in x.collect()} == pytest.approx({"a": 1.0, "b": 0.6, "d": 0.24})
    assert {r.flow_id: r.q for r in matrix.inventory(matrix.biosphere(rows), x).collect()}["co2"] == pytest.approx(0.96)
    assert {r.flow_id: r.synonyms for r in ecospold2.flows(rows).collect()}["y"] == ["syn y"]


def test_export(spark, files, tmp_path):
    rows = ecospold2.cut_off(ecospold2.read(spark, files))
    acts = rows.selectExpr("act_id", "act_name as name", "act_location as location", "'kg' as unit").distinct()
    a, f = export.indexes(acts, ecospold2.flows(rows).where("category is not null"))
    reference = rows.where("is_reference").select("act_id", "amount")
    got = {(r["row"], r["column"]): r.coefficient for r in export.technosphere(a, matrix.technosphere(rows), reference).collect()}
    assert got == pytest.approx({(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0, (1, 0): -0.6, (2, 1): -0.4})
    bio = export.biosphere(a, f, matrix.biosphere(rows))
    assert {(r["row"], r["column"]): r.coefficient for r in bio.collect()} == {(0, 2): 4.0, (1, 2): 1.0}
    export.write(bio, f"{tmp_path}/B")
    assert len(spark.read.option("sep", ";").option("header", "true").csv(f"{tmp_path}/B").columns) == 8


def test_tables(spark):
    about, factors = tables.methods(spark, "# methodology: X\n;;Climate;Water\n;;GWP;Use\n;;kg CO2;m3\nsubstance;compartment\nCO2;air;1;\nCH4;air;28,5;0\nWater;water;;1\n")
    assert sorted(map(tuple, about.collect())) == [("GWP", "Climate", "kg CO2"), ("Use", "Water", "m3")]
    assert sorted(map(tuple, factors.collect())) == [("GWP", "CH4", "air", 28.5), ("GWP", "CO2", "air", 1.0), ("Use", "CH4", "air", 0.0), ("Use", "Water", "water", 1.0)]
    assert sorted(map(tuple, tables.weighting(spark, "category;normalization;weighting\nGWP;0.1;\nUse;x;2\n").collect())) == [("GWP", 0.1, 0.0), ("Use", 0.0, 2.0)]
    got = {r.name: r.factor for r in tables.unit_table(spark, "name,dimension,factor\nkg,mass,1\nt,mass,1000", "t,mass,1001").collect()}
    assert got == {"kg": 1.0, "t": 1001.0}
