"""Registry of exchangeable parts: named functions by kind, in order of priority."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

KINDS = ("importer", "exporter", "searcher", "mapper", "transform", "validator", "analyzer", "reporter")
EXTERNAL_PRIORITY = 50


class PluginError(RuntimeError):
    """An external program failed, or didn't answer in JSON."""


@dataclass(frozen=True)
class Plugin:
    kind: str
    name: str
    run: Callable
    priority: int = 0


@dataclass
class Registry:
    """Plugins by kind and name; of a name the last one registered holds."""

    plugins: dict[tuple[str, str], Plugin] = field(default_factory=dict)

    def add(self, plugin: Plugin) -> None:
        if plugin.kind not in KINDS:
            raise ValueError(f"no kind {plugin.kind!r}")
        self.plugins[plugin.kind, plugin.name] = plugin

    def of(self, kind: str) -> list[Plugin]:
        return sorted((p for p in self.plugins.values() if p.kind == kind), key=lambda p: (p.priority, p.name))

    def configure(self, entries: Iterable[Mapping]) -> Registry:
        """A registry changed by entries (kind, name, and enabled, priority or command).

        enabled = false takes a plugin out, priority moves it, command puts an external program in.
        """
        out = Registry(dict(self.plugins))
        for e in entries:
            key = (e["kind"], e["name"])
            if e.get("enabled", True) is False:
                out.plugins.pop(key, None)
            elif "command" in e:
                out.add(Plugin(*key, external(e["command"]), e.get("priority", EXTERNAL_PRIORITY)))
            elif key in out.plugins and "priority" in e:
                out.plugins[key] = replace(out.plugins[key], priority=e["priority"])
        return out


def external(command: list[str], timeout: float = 60) -> Callable:
    """A function that gives its argument to a program as JSON and reads its answer."""

    def run(value):
        return json.loads(_call(command, json.dumps(value), timeout))

    return run


def external_batch(command: list[str], values: Iterable, timeout: float = 600) -> list:
    """One call for many values: a line of JSON for each, and one in answer."""
    lines = [json.dumps(v) for v in values]
    found = [json.loads(line) for line in _call(command, "".join(f"{x}\n" for x in lines), timeout).splitlines() if line.strip()]
    if len(found) != len(lines):
        raise PluginError(f"{command[0]} gave {len(found)} answers to {len(lines)} values")
    return found


def _call(command: list[str], text: str, timeout: float) -> str:
    try:
        done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError) as e:
        raise PluginError(f"{command[0]}: {e}") from e
    if not done.stdout.strip() and text.strip():
        raise PluginError(f"{command[0]} gave no answer")
    return done.stdout


def failed(issues: Iterable[Mapping]) -> bool:
    """Whether a validator's issues stop the work."""
    return any(i.get("severity") == "error" for i in issues)
