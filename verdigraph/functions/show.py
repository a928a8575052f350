"""Results as text: JSON, CSV, tables; numbers and sizes for people; names of strategies."""

from __future__ import annotations

import csv
import html
import io
import json

#: Matching strategies by their names in results; an unknown one is fuzzy.
_STRATEGIES = {"uuid": "ByUUID", "cas": "ByCAS", "name": "ByName", "synonym": "BySynonym", "fuzzy": "ByFuzzy"}


def strategy_text(strategy: str) -> str:
    return _STRATEGIES.get(strategy, _STRATEGIES["fuzzy"])


def strategy_of(text: str) -> str:
    return next((k for k, v in _STRATEGIES.items() if text.lower() in (k, v.lower())), "fuzzy")


def size_text(n: float) -> str:
    """Bytes for people: 1.5 KB."""
    for unit in ("B", "KB", "MB", "GB"):
        if abs(n) < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def time_text(seconds: float) -> str:
    """A duration for people: 850 ms, 3.2 s, 2 min 5 s."""
    if seconds < 1:
        return f"{seconds * 1000:.0f} ms"
    return f"{seconds:.1f} s" if seconds < 60 else f"{int(seconds // 60)} min {int(seconds % 60)} s"


def entities(text: str) -> str:
    """XML's character references decoded."""
    return html.unescape(text)


def rows_of(value) -> list[dict] | None:
    """The rows of a result: a list, or the only list among a result's fields."""
    if isinstance(value, list):
        return value if all(isinstance(r, dict) for r in value) else None
    lists = [v for v in value.values() if isinstance(v, list)] if isinstance(value, dict) else []
    return rows_of(lists[0]) if len(lists) == 1 else None


def render(value, style: str = "json") -> str:
    """A result as json, pretty, csv or table; columns are the first row's; what has no rows is JSON in any style."""
    rows = rows_of(value) if style in ("csv", "table") else None
    if not rows:
        return json.dumps(value, indent=2 if style != "json" else None, ensure_ascii=False, default=str)
    columns = list(rows[0])
    cells = [["" if r.get(c) is None else r[c] if isinstance(r[c], str) else json.dumps(r[c], default=str) for c in columns] for r in rows]
    if style == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([columns, *cells])
        return out.getvalue()
    widths = [max(len(x) for x in column) for column in zip(columns, *cells, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in [columns, ["-" * w for w in widths], *cells])
