"""Small helpers for XML formats whose namespaces differ from file to file."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator


def tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    """The first element along a path of local names."""
    for name in path:
        e = next((c for c in e if tag(c) == name), None) if e is not None else None
    return e


def children(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e if tag(c) == name] if e is not None else []


def descendants(e: ET.Element | None, name: str) -> Iterator[ET.Element]:
    return (c for c in e.iter() if tag(c) == name) if e is not None else iter(())


def text(e: ET.Element | None) -> str:
    return "".join(e.itertext()).strip() if e is not None else ""


def number(value: str | None, default: float | None = 0.0) -> float | None:
    try:
        return float(value or "")
    except ValueError:
        return default
