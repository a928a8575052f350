import pytest
from pyspark.sql import functions as F

from verdigraph.sources import ecospold1, ilcd, simapro, simapro_methods

ES1 = """<?xml version="1.0"?><ecoSpold xmlns="http://x/01">
<dataset number="7"><metaInformation><processInformation><referenceFunction name="power" category="Energy" subCategory="Wind" unit="kWh"/><geography location="DE"/></processInformation></metaInformation>
<flowData><exchange number="7" name="power" category="Energy" unit="kWh" meanValue="1.0"><outputGroup>0</outputGroup></exchange>
<exchange number="9" name="steel" category="Metals" unit="kg" meanValue="0.5" location="GLO"><inputGroup>5</inputGroup></exchange>
<exchange number="3" name="CO2" category="air" subCategory="low" unit="kg" meanValue="0.01" CASNumber="124-38-9"><outputGroup>4</outputGroup></exchange></flowData></dataset>
<dataset number="9"><metaInformation><processInformation><referenceFunction name="steel" unit="kg"/></processInformation></metaInformation>
<flowData><exchange number="9" name="steel" unit="kg" meanValue="1"><outputGroup>0</outputGroup></exchange></flowData></dataset></ecoSpold>"""


def test_ecospold1(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ES1)
    (tmp_path / "b.xml").write_text("<broken")
    rows = ecospold1.read(spark, str(tmp_path)).collect()
    good = sorted((r for r in rows if not r.error), key=lambda r: (r.number, r.seq))
    assert [(r.act_name, r.flow_name, r.kind, r.is_input, r.is_reference, r.supplier_number) for r in good] == [
        ("power", "power", "technosphere", False, True, None), ("power", "steel", "technosphere", True, False, 9), ("power", "CO2", "biosphere", False, False, None), ("steel", "steel", "technosphere", False, True, None),
    ]
    assert good[0].classes == {"Category": "Energy", "SubCategory": "Wind"} and good[2].category == "air/low" and good[3].act_location == "GLO"
    assert good[0].act_id == str(ecospold1.uuid.uuid5(ecospold1.NAMESPACE, "power:DE")) and len({r.flow_id for r in good}) == 4
    assert sum(r.error is not None for r in rows) == 1


CSV = """{SimaPro 9}
{CSV separator: Semicolon}
{Decimal separator: ,}

Project Input parameters
scale;2;x

Process

Category type
material

Process name
Dairy {FR}

Products
Milk {FR};g;1000;60*half;none;Food
Cream {FR};kg;1;40;none;Food

Avoided products
Feed;kg;0,5

Materials/fuels
Grass [DE];kg;scale*3;Undefined
Nothing;kg;0;Undefined

Resources
Water;in ground;m3;1,5;Undefined

Emissions to air
Methane;;kg;late/2;Undefined

Input parameters
half;0,5

Calculated parameters
late;scale*later
later;half+0,5

End

Process

Products
Grass;kg;1;100;none;Plants

End
"""


def test_simapro_activities_and_links(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes(CSV.encode())
    rows = simapro.read(spark, str(tmp_path))
    got = rows.collect()
    assert {(r.act_name, r.act_location, r.act_unit) for r in got} == {("Milk", "FR", "kg"), ("Cream", "FR", "kg"), ("Grass", "", "kg")}
    milk = {r.flow_name: r for r in got if r.act_name == "Milk"}
    assert milk["Milk"].amount == 1.0 and milk["Milk"].is_reference and milk["Milk"].classes == {"Category type": "material", "Category": "Food"}
    assert {n: milk[n].amount for n in ("Feed", "Grass", "Water", "Methane")} == pytest.approx({"Feed": 0.15, "Grass": 1.8, "Water": 0.45, "Methane": 0.3})
    assert "Nothing" not in milk and milk["Water"].category == "resource/in ground" and milk["Water"].is_input and not milk["Feed"].is_input and milk["Grass"].location == "DE"
    assert {r.amount for r in got if r.act_name == "Cream" and r.flow_name == "Feed"} == {0.2}
    linked = {(r.act_name, r.flow_name): r.link for r in simapro.link(rows).collect()}
    grass = next(r.act_id for r in got if r.act_name == "Grass")
    assert linked["Milk", "Grass"] == grass and linked["Milk", "Feed"] is None and linked["Milk", "Milk"] is None
    assert simapro.place_of("Steel//[GB] plant") == ("Steel plant", "GB") and simapro.place_of("Iron/RER U") == ("Iron", "RER") and simapro.place_of("Ore") == ("Ore", "")


UG = '<u xmlns:c="c"><c:UUID>{}</c:UUID><referenceToReferenceUnit>1</referenceToReferenceUnit><units><unit dataSetInternalID="0"><name>g</name></unit><unit dataSetInternalID="1"><name>kg</name></unit></units></u>'
FP = '<p><UUID>{}</UUID><referenceToReferenceUnitGroup refObjectId="{}"/></p>'
FL = """<f><flowInformation><dataSetInformation><UUID>{}</UUID><name><baseName>{}</baseName></name><synonyms>a; b</synonyms>
<category level="1">Emissions to air</category><category level="0">Emissions</category><category level="2">Emissions to air, unspecified</category><CASNumber>124-38-9</CASNumber></dataSetInformation>
<quantitativeReference><referenceToReferenceFlowProperty>0</referenceToReferenceFlowProperty></quantitativeReference></flowInformation><typeOfDataSet>{}</typeOfDataSet>
<flowProperties><flowProperty dataSetInternalID="0"><referenceToFlowPropertyDataSet refObjectId="p1"/></flowProperty></flowProperties></f>"""
PR = """<r><processInformation><dataSetInformation><UUID>{}</UUID><name><baseName>{}</baseName></name><class level="0">Energy</class></dataSetInformation><geography location="FR"/>
<quantitativeReference><referenceToReferenceFlow>0</referenceToReferenceFlow></quantitativeReference></processInformation><exchanges>{}</exchanges></r>"""
EX = '<exchange dataSetInternalID="{}"><referenceToFlowDataSet refObjectId="{}"/><exchangeDirection>{}</exchangeDirection>{}</exchange>'


def test_ilcd_package_and_links(spark, tmp_path):
    for folder in ("unitgroups", "flowproperties", "flows", "processes"):
        (tmp_path / folder).mkdir()
    (tmp_path / "unitgroups/u.xml").write_text(UG.format("U1"))
    (tmp_path / "flowproperties/p.xml").write_text(FP.format("P1", "U1"))
    (tmp_path / "flows/a.xml").write_text(FL.format("co2", "Carbon dioxide", "Elementary flow"))
    (tmp_path / "flows/b.xml").write_text(FL.format("coal", "Coal", "Product flow"))
    (tmp_path / "flows/bad.xml").write_text("<f")
    (tmp_path / "processes/x.xml").write_text(PR.format("mine", "Mining", EX.format(0, "coal", "Output", "<resultingAmount>2</resultingAmount>") + EX.format(1, "co2", "Output", "<meanAmount>3</meanAmount>")))
    (tmp_path / "processes/y.xml").write_text(PR.format("burn", "Burning", EX.format(0, "heat", "Output", "<resultingAmount>1</resultingAmount>") + EX.format(4, "coal", "Input", "<resultingAmount>0.5</resultingAmount>")))
    rows = ilcd.link(ilcd.read(spark, str(tmp_path))).collect()
    by = {(r.act_id, r.flow_id): r for r in rows}
    assert len(rows) == 4 and by["burn", "coal"].link == "mine" and by["mine", "coal"].link is None and by["mine", "coal"].is_reference
    assert by["mine", "co2"].kind == "biosphere" and by["mine", "co2"].amount == 3 and by["mine", "co2"].category == "air/unspecified" and by["mine", "co2"].unit == "kg"
    assert by["burn", "heat"].flow_name is None and by["burn", "heat"].unit == "kg" and by["mine", "co2"].synonyms == ["a", "b"]
    method = '<m><LCIAMethodInformation><dataSetInformation><UUID>m1</UUID><name>GWP</name><impactCategory>Climate</impactCategory></dataSetInformation></LCIAMethodInformation><factor><referenceToFlowDataSet refObjectId="CO2"/><exchangeDirection>Output</exchangeDirection><meanValue>1.5</meanValue></factor><factor><referenceToFlowDataSet refObjectId="zz"><shortDescription>Lead (Emissions to water, fresh)</shortDescription></referenceToFlowDataSet><exchangeDirection>Output</exchangeDirection><meanValue>7</meanValue></factor></m>'
    (tmp_path / "lcia").mkdir()
    (tmp_path / "lcia/m.xml").write_text(method)
    found = {r.flow_id: (r.method, r.cf_name, r.medium, r.cf) for r in ilcd.methods(spark, str(tmp_path / "lcia"), ilcd.flows(spark, str(tmp_path))).collect()}
    assert found == {"co2": ("GWP", "Carbon dioxide", "air", 1.5), "zz": ("GWP", "Lead", "water", 7.0)}


METHODS = """{SimaPro 9}
{methods}
{CSV separator: Semicolon}
{Decimal separator: ,}

Method

Name
Mine

Impact category
Climate;kg CO2 eq

Substances
Air;(unspecified);Methane;000074-82-8;28,5;kg
Raw;in ground;Coal;;1;kg

Impact category
Ozone;kg

Substances
Air;high. pop.;CFC;;2;kg

Damage category
Health;DALY

Impact categories
Climate;0,5

Normalization-Weighting set
World

Normalization
Climate;0,1
Ozone;3

Weighting
Climate;0,25

End
"""


def test_simapro_methods(spark, tmp_path):
    (tmp_path / "m.csv").write_text(METHODS)
    (tmp_path / "d.csv").write_text(CSV)
    rows = simapro_methods.read(spark, str(tmp_path))
    got = sorted((r.method, r.cf_name, r.medium, r["sub"], r.is_input, r.cf) for r in simapro_methods.factors(rows).collect())
    assert got == [("Climate", "Coal", "natural resource", "in ground", True, 1.0), ("Climate", "Methane", "air", "", False, 28.5), ("Ozone", "CFC", "air", "high. pop.", False, 2.0)]
    assert sorted((r.set_name, r.method, r.n, r.w) for r in simapro_methods.sets(rows).collect()) == [("World", "Climate", 0.1, 0.25), ("World", "Ozone", 3.0, None)]
    assert [tuple(r) for r in simapro_methods.damages(rows).collect()] == [("Health", "Climate", 0.5)] and rows.where(F.col("kind") == "category").count() == 2
