"""Histories, rule files and configurations."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lintlake.functions.rules import AST_RULES, Rule

HISTORY = "timestamp string, author string, project string, pr_number int, metrics map<string,double>"
CONFIG_NAMES = (".lintlake.yml", ".lintlake.yaml", "lintlake.yml")
IGNORE_NAME = ".lintlakeignore"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Score entries from JSON arrays; unknown fields drop out, a corrupt file has no entries. seq is the order of appearance."""
    rows = spark.read.schema(HISTORY + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    kept = rows.where("_corrupt is null and (timestamp is not null or author is not null)").drop("_corrupt")
    return kept.selectExpr("monotonically_increasing_id() AS seq", "*")


def append_history(entries: DataFrame, path: str) -> None:
    """New entries as new files beside the old ones: nothing is read or written again."""
    entries.write.mode("append").parquet(path)


def drop_history(spark: SparkSession, path: str) -> None:
    """Remove a history folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _parsed(path: Path) -> Any:
    """JSON always, YAML where its library is installed; unreadable files are empty."""
    try:
        text = path.read_text(encoding="utf-8")
        if path.suffix == ".json":
            return json.loads(text)
        import yaml

        return yaml.safe_load(text)
    except Exception:
        return None


_FLAGS = {"ignorecase": "i", "multiline": "m", "dotall": "s"}


def rule_from(entry: Any) -> Rule | None:
    """A rule from a mapping; one that is none is dropped."""
    if not isinstance(entry, Mapping) or not entry.get("id"):
        return None
    kind = str(entry.get("type", "pattern")).lower()
    if kind not in ("pattern", "threshold", "ast"):
        return None
    pattern = str(entry.get("pattern") or "")
    flags = "".join(_FLAGS.get(str(f).lower(), "") for f in entry.get("flags") or ())
    try:
        limit = None if entry.get("max") is None and entry.get("max_value") is None else int(entry.get("max", entry.get("max_value")))
    except (TypeError, ValueError):
        return None
    return Rule(str(entry["id"]), str(entry.get("severity", "medium")).lower(), f"(?{flags}){pattern}" if flags and pattern else pattern, str(entry.get("title", "")), kind, entry.get("metric"), limit, entry.get("ast_check") or entry.get("check"), tuple(entry.get("include") or ()), tuple(entry.get("exclude") or ()), bool(entry.get("enabled", True)))


def rules_of(config: Mapping[str, Any], folder: str | Path = ".") -> list[Rule]:
    """Built-in syntax-tree rules (all by default), then inline rules, then those of files; none if disabled."""
    if not config.get("enabled", True):
        return []
    names = config.get("builtin")
    builtin = [Rule(n, AST_RULES[n], type="ast", ast_check=n) for n in (AST_RULES if names is None else names) if n in AST_RULES]
    inline: Iterable[Any] = config.get("custom") or ()
    filed: list[Any] = []
    for name in config.get("files") or ():
        found = _parsed(Path(folder) / name)
        filed += (found.get("rules") if isinstance(found, Mapping) else found) or []
    return [*builtin, *[r for r in map(rule_from, [*inline, *filed]) if r]]


def merged(defaults: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Mappings merge deeply; lists and single values override."""
    out = dict(defaults)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), Mapping) and isinstance(v, Mapping) else v
    return out


def _upwards(start: str | Path) -> Iterable[Path]:
    here = Path(start).resolve()
    return (here, *here.parents)


def find_config(start: str | Path, defaults: Mapping[str, Any]) -> dict[str, Any]:
    """The first configuration file upwards from a folder, over the defaults."""
    for folder in _upwards(start):
        for name in CONFIG_NAMES:
            if (folder / name).exists():
                found = _parsed(folder / name)
                return merged(defaults, found) if isinstance(found, Mapping) else dict(defaults)
    return dict(defaults)


def find_ignore(start: str | Path) -> list[str]:
    """The lines of the first ignore file upwards from a folder."""
    for folder in _upwards(start):
        if (folder / IGNORE_NAME).exists():
            return (folder / IGNORE_NAME).read_text(encoding="utf-8").splitlines()
    return []
