"""Plugins: registration, order, and running them over files as one plan."""

from __future__ import annotations

import heapq
import logging
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.operators.complexity import language_of

log = logging.getLogger(__name__)
KINDS = ("checker", "fixer", "reporter", "formatter", "analyzer", "custom")
RESULT = T.StructType([T.StructField("plugin", T.StringType()), T.StructField("file", T.StringType()), T.StructField("message", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("severity", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("fix", T.StringType()), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())), T.StructField("error", T.StringType())])


@dataclass(frozen=True)
class Option:
    """A typed setting: required or with a default, perhaps one of some choices; values are passed to the type."""

    name: str
    type: Callable[[Any], Any] = str
    required: bool = False
    default: Any = None
    choices: tuple = ()


@dataclass(frozen=True)
class Plugin:
    """on_file(path, content, settings) gives issues (mappings with message, line, severity, rule, fix) and may
    give metrics under the key `metrics`; the schema of both is fixed, so that results are a table."""

    name: str
    on_file: Callable[[str, str, Mapping[str, Any]], Iterable[Mapping[str, Any]]]
    version: str = "0.0.0"
    kind: str = "checker"
    priority: int = 100
    dependencies: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    options: tuple[Option, ...] = ()
    needs: str = "0"
    on_complete: Callable[[DataFrame], DataFrame] | None = None

    def settings(self, given: Mapping[str, Any]) -> dict[str, Any]:
        unknown = set(given) - {o.name for o in self.options}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out = {}
        for o in self.options:
            if o.name not in given:
                if o.required:
                    raise ValueError(f"missing setting: {o.name}")
                out[o.name] = o.default
                continue
            out[o.name] = o.type(given[o.name])
            if o.choices and out[o.name] not in o.choices:
                raise ValueError(f"{o.name} must be one of {o.choices}")
        return out


def version_parts(text: str) -> tuple[int, ...]:
    """Dotted numbers up to the first part that is none."""
    out: list[int] = []
    for part in text.split("."):
        if not part.isdigit():
            break
        out.append(int(part))
    return tuple(out)


@dataclass
class Registry:
    """Registered plugins; a second one of a name takes the first one's place."""

    plugins: dict[str, Plugin] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def register(self, plugin: Plugin) -> Plugin:
        if plugin.name in self.plugins:
            log.warning("plugin %s is replaced", plugin.name)
        if plugin.kind not in KINDS:
            raise ValueError(f"unknown kind: {plugin.kind}")
        self.plugins[plugin.name] = plugin
        return plugin

    def unregister(self, name: str) -> None:
        self.plugins.pop(name, None)

    def enable(self, name: str, on: bool = True) -> None:
        (self.disabled.discard if on else self.disabled.add)(name)

    def names(self, *found: str) -> list[str]:
        """Names of all plugins, registered or found elsewhere, each once."""
        return sorted({*self.plugins, *found})

    def info(self, name: str) -> dict[str, Any] | None:
        """What is known of a plugin."""
        p = self.plugins.get(name)
        return p and {"name": p.name, "version": p.version, "kind": p.kind, "priority": p.priority, "dependencies": list(p.dependencies), "missing": missing(p, self.plugins), "languages": list(p.languages), "options": [o.name for o in p.options], "enabled": name not in self.disabled}

    def usable(self, version: str, only: Sequence[str] | None = None) -> dict[str, Plugin]:
        """Enabled plugins whose needed version is met and whose dependencies are registered."""
        chosen = {n: p for n, p in self.plugins.items() if n not in self.disabled and (only is None or n in only)}
        return {n: p for n, p in chosen.items() if version_parts(version) >= version_parts(p.needs) and not missing(p, self.plugins)}


def missing(plugin: Plugin, known: Mapping[str, Plugin]) -> list[str]:
    return [d for d in plugin.dependencies if d not in known]


def run_order(plugins: Mapping[str, Plugin]) -> list[str]:
    """Dependencies first, then by priority and name; members of a cycle come last, by priority."""
    waits = {n: sum(d in plugins for d in p.dependencies) for n, p in plugins.items()}
    ready = [(p.priority, n) for n, p in plugins.items() if not waits[n]]
    heapq.heapify(ready)
    order: list[str] = []
    while ready:
        _, name = heapq.heappop(ready)
        order.append(name)
        for n, p in plugins.items():
            if name in p.dependencies:
                waits[n] -= p.dependencies.count(name)
                if waits[n] == 0:
                    heapq.heappush(ready, (p.priority, n))
    rest = [n for n in plugins if n not in order]
    if rest:
        log.warning("plugins depend on each other: %s", ", ".join(rest))
    return order + sorted(rest, key=lambda n: plugins[n].priority)


def run_plugins(files: DataFrame, plugins: Mapping[str, Plugin], settings: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """Every plugin over every file (file, content) of its languages, in order, in one pass over the files.

    A plugin that fails on a file leaves a row with its error; nothing ends the job. Plugins travel to the
    workers by value."""
    order = [(plugins[n], plugins[n].settings((settings or {}).get(n, {}))) for n in run_order(plugins)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, content, language in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for plugin, own in order:
                    if plugin.languages and (language or "").lower() not in {x.lower() for x in plugin.languages}:
                        continue
                    try:
                        for issue in plugin.on_file(path, content, own) or ():
                            rows.append({"plugin": plugin.name, "file": path, **{k: issue.get(k) for k in ("message", "line", "severity", "rule", "fix")}, "metrics": list((issue.get("metrics") or {}).items()), "error": None})
                    except Exception as wrong:
                        rows.append({"plugin": plugin.name, "file": path, "message": None, "line": None, "severity": None, "rule": None, "fix": None, "metrics": [], "error": f"{type(wrong).__name__}: {wrong}"[:500]})
            kinds = pa.schema([("plugin", pa.string()), ("file", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("severity", pa.string()), ("rule", pa.string()), ("fix", pa.string()), ("metrics", pa.map_(pa.string(), pa.float64())), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("file", "content", language_of(F.col("file")).alias("language")).mapInArrow(run, RESULT)


def complete(results: DataFrame, plugins: Mapping[str, Plugin]) -> dict[str, DataFrame]:
    """What each plugin makes of its own results."""
    return {n: p.on_complete(results.where(F.col("plugin") == n)) for n, p in plugins.items() if p.on_complete}


TEMPLATE = '''"""{name}: a plugin."""

from lintlake.plans.plugins import Plugin


def on_file(path, content, settings):
    yield {{"message": "...", "line": 1, "severity": "info", "rule": "{name}"}}


plugin = Plugin("{name}", on_file)
'''


def scaffold(name: str) -> str:
    return TEMPLATE.format(name=name)
