import sys

import pytest

from verdigraph.plans import dependencies as D
from verdigraph.plans import plugins as P

NEEDS = {"a": ["b", "c"], "b": ["d"], "c": [], "d": [], "x": ["y"], "y": ["x"], "z": ["gone"]}


def test_levels():
    assert D.levels(["a"], NEEDS) == [["c", "d"], ["b"], ["a"]]
    assert D.dependents("d", ["a", "b", "d"], NEEDS) == ["b"]
    for bad in ("x", "z", "none"):
        with pytest.raises(D.DependencyError):
            D.levels([bad], NEEDS)


def test_registry():
    r = P.Registry()
    for n, p in (("late", 20), ("early", 0), ("mid", 10)):
        r.add(P.Plugin("mapper", n, str, p))
    got = r.configure([{"kind": "mapper", "name": "early", "enabled": False}, {"kind": "mapper", "name": "late", "priority": 5}, {"kind": "mapper", "name": "ext", "command": ["true"]}])
    assert [p.name for p in got.of("mapper")] == ["late", "mid", "ext"] and [p.name for p in r.of("mapper")] == ["early", "mid", "late"]
    with pytest.raises(ValueError):
        r.add(P.Plugin("thing", "x", str))
    assert P.failed([{"severity": "error"}]) and not P.failed([{"severity": "warning"}])


def test_external_programs():
    echo = [sys.executable, "-c", "import sys; sys.stdout.write(sys.stdin.read())"]
    assert P.external(echo)({"a": 1}) == {"a": 1}
    assert P.external_batch(echo, [1, "x", None]) == [1, "x", None]
    for bad in (["/nonexistent"], [sys.executable, "-c", "exit(1)"], [sys.executable, "-c", ""]):
        with pytest.raises(P.PluginError):
            P.external(bad)(1)
