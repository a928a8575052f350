import math
import uuid

import pytest
from pyspark.sql import functions as F

from verdigraph.functions import expr, units
from verdigraph.functions import text as T


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names))).first()[0]


@pytest.mark.parametrize("given, want", [("iron, in ground", "iron"), ("carbon (IV) oxide,  fossil", "carbon iv oxide fossil"), ("Water/kg", "water"), ("  A  'b' ", "a b")])
def test_normalize_name(spark, given, want):
    assert one(spark, T.normalize_name, given) == want


def test_text_keys(spark):
    assert one(spark, T.link_key, " Steel – hot ") == "steel - hot"
    assert one(spark, T.tokens, "Lait demi-écrémé, 1L") == ["lait", "demi", "ecreme", "1l"]
    assert one(spark, T.trigrams, "abcabc") == ["abc", "bca", "cab"]
    assert one(spark, T.trigrams, "ab") == []
    assert one(spark, T.cas_first, "000074-82-8") == "74-82-8"
    assert (one(spark, T.cas_first, "50-00-0"), one(spark, T.cas_every, "50-00-0"), one(spark, T.cas_every, "0-0-0")) == ("50-00-0", "50-0-0", None)
    assert one(spark, T.bracketed_location, "Milk {FR} [CH]") == "FR" and one(spark, T.bracketed_location, "Milk [CH]") == "CH"
    assert one(spark, T.product_prefixes, "Milk {FR}| mass // x") == ["Milk {FR}| mass", "Milk"]
    assert one(spark, T.slug, "A b/C_d") == "a-b-c_d"
    assert one(spark, T.escape_csv, 'a;"b"') == '"a;""b"""'
    assert one(spark, T.medium, "Emissions to water") == "water"
    assert one(spark, lambda c: T.uuid5(str(uuid.NAMESPACE_URL), c), "x:y") == str(uuid.uuid5(uuid.NAMESPACE_URL, "x:y"))


def test_units(spark):
    defs = units.from_rows(spark)
    rows = spark.createDataFrame([(1.0, "tkm", "kgkm"), (1.0, "t", "kg"), (1.0, "kWh", "MJ"), (1.0, "kg", "m"), (2.0, "x", "kg"), (2.0, None, "kg")], "v double, a string, b string")
    assert [r.o for r in units.with_conversion(rows, defs, "v", "a", "b", "o").collect()] == [1000.0, 1000.0, 3.6, None, None, None]
    assert {r.name: r.unit for r in units.canonical(defs).collect()}["lb"] == "kg"
    assert [r.name for r in units.unknown(rows, defs, "a").collect()] == ["x"]
    assert units.parse_dimension("mass*length/time")[:3] == [1, 1, -1]
    with pytest.raises(ValueError):
        units.parse_dimension("mass*nonsense")


def test_formulas():
    assert expr.evaluate("2 + 3 * 4 ^ 2 ^ 0.5 - -1") == pytest.approx(2 + 3 * 4 ** (2**0.5) + 1)
    assert expr.evaluate("-2^2") == -4 and expr.evaluate("min(A; 3) / max(1; b)", {"a": 2, "B": 4}) == 0.5
    assert expr.evaluate("1/0") == math.inf and math.isnan(expr.evaluate("0/0"))
    assert expr.evaluate("1,5*2", decimal_comma=True) == 3.0
    assert expr.identifiers("a + sqrt(b) * a") == ["a", "b"]
    assert expr.resolve({"c": "b*2", "b": "a+1", "d": "nowhere"}, {"a": 1}) == {"a": 1, "b": 2.0, "c": 4.0}
    for bad in ("", "1 +", "(1", "f(1)", "1 2", "2^-1"):
        with pytest.raises(expr.FormulaError):
            expr.evaluate(bad)
