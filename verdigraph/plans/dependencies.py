"""Order in which databases load: those that others link to come first."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from graphlib import CycleError, TopologicalSorter


class DependencyError(ValueError):
    """Databases depend on each other, or on one that isn't known."""


def closure(wanted: Iterable[str], needs: Mapping[str, Iterable[str]]) -> set[str]:
    """The wanted databases and all that they need."""
    found, open_ = set(), list(wanted)
    while open_:
        name = open_.pop()
        if name in found:
            continue
        if name not in needs:
            raise DependencyError(f"no database {name}")
        found.add(name)
        open_ += needs[name]
    return found


def levels(wanted: Iterable[str], needs: Mapping[str, Iterable[str]]) -> list[list[str]]:
    """Groups in order of loading; a group's databases need only earlier ones and can load side by side."""
    chosen = closure(wanted, needs)
    order = TopologicalSorter({n: needs[n] for n in chosen})
    try:
        order.prepare()
    except CycleError as e:
        raise DependencyError("databases need each other: " + " -> ".join(e.args[1])) from e
    out = []
    while order.is_active():
        ready = sorted(order.get_ready())
        out.append(ready)
        order.done(*ready)
    return out


def dependents(name: str, loaded: Iterable[str], needs: Mapping[str, Iterable[str]]) -> list[str]:
    """Loaded databases that keep this one from being unloaded."""
    return sorted(n for n in loaded if n != name and name in needs.get(n, ()))
