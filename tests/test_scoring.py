import pytest

from verdigraph.functions.expr import FormulaError
from verdigraph.functions.scoring import ScoringSet, score, score_all

RAW = {"Climate": 10.0, "Water": 4.0}


def one(**changes):
    base = {"name": "s", "variables": {"c": "Climate", "w": "Water", "gone": "Land"}, "scores": {"total": "c + w + both", "c only": "C"}, "computed": {"twice": "both * 2", "both": "c + w"}, "normalization": {"c": 5.0}, "weighting": {"c": 0.5, "w": 0.25, "both": 1.0, "twice": 1.0}, "multiplier": 100.0}
    return ScoringSet(**(base | changes))


def test_formulas_over_weighed_scores():
    got = score(one(), RAW)
    assert got.scores == pytest.approx({"total": (1 + 1 + 14) * 100, "c only": 100.0})
    assert got.indicators == pytest.approx({"c": 100.0, "w": 100.0, "both": 1400.0})


def test_sets_that_fail_are_left_out():
    with pytest.raises(FormulaError):
        score(one(computed={"a": "b", "b": "a"}), RAW)
    bad = [one(name="missing", scores={"x": "gone"}), one(name="odd", scores={"x": "1 +"}), one(name="good")]
    assert list(score_all(bad, RAW)) == ["good"]
