"""Scoring sets: formulas over a method collection's scores, normalised and weighted."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from .expr import FormulaError, evaluate, identifiers


@dataclass(frozen=True)
class ScoringSet:
    """variables name a method each, computed and scores are formulas; factors divide, weights multiply."""

    name: str
    variables: dict[str, str]
    scores: dict[str, str]
    computed: dict[str, str] = field(default_factory=dict)
    normalization: dict[str, float] = field(default_factory=dict)
    weighting: dict[str, float] = field(default_factory=dict)
    multiplier: float = 1.0


@dataclass(frozen=True)
class Scored:
    scores: dict[str, float]
    indicators: dict[str, float]


def _in_order(formulas: dict[str, str]) -> list[str]:
    """Formulas after those that they use."""
    low = {k.lower(): k for k in formulas}
    uses = {k: {low[i.lower()] for i in identifiers(f) if i.lower() in low} for k, f in formulas.items()}
    try:
        return list(TopologicalSorter(uses).static_order())
    except CycleError as e:
        raise FormulaError(f"formulas use each other: {e.args[1]}") from e


def score(chosen: ScoringSet, raw: dict[str, float]) -> Scored:
    """Scores of one root, from its raw score by method. A method that isn't there leaves its variable out.

    Raises FormulaError where a formula lacks a variable or is none.
    """
    values = {v: raw[m] for v, m in chosen.variables.items() if m in raw}
    for name in _in_order(chosen.computed):
        values[name] = evaluate(chosen.computed[name], values)
    weighed = {v: x / chosen.normalization.get(v, 1.0) * chosen.weighting.get(v, 0.0) for v, x in values.items()}
    scores = {n: evaluate(f, weighed) * chosen.multiplier for n, f in chosen.scores.items()}
    used = {i.lower() for f in chosen.scores.values() for i in identifiers(f)}
    return Scored(scores, {v: x * chosen.multiplier for v, x in weighed.items() if v.lower() in used})


def score_all(sets: list[ScoringSet], raw: dict[str, float]) -> dict[str, Scored]:
    """All sets that can be scored; those that can't are left out."""
    out = {}
    for chosen in sets:
        try:
            out[chosen.name] = score(chosen, raw)
        except FormulaError:
            continue
    return out
