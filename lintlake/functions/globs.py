"""Ignore files: patterns with negation, as regular expressions that Spark evaluates."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path_pattern(pattern: str) -> str:
    """Only . ? * and ** are translated; other signs keep their meaning in a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {".": r"\.", "?": "[^/]", "*": "[^/]*"}.get(pattern[i], pattern[i])
            i += 1
    return out


def _whole(glob: str) -> str:
    """A shell pattern as an expression for a whole text, in Java's notation."""
    return "^(?:" + re.sub(r"\\Z$|\\z$", "", fnmatch.translate(glob)).removeprefix("(?s:").removesuffix(")") + ")$"


def _matched(path: Column, pattern: str) -> Column:
    bare = pattern.rstrip("/")
    found = path.rlike(_path_pattern(bare))
    if "/" not in bare:
        found = found | F.element_at(F.split(path, "/"), -1).rlike("(?s)" + _whole(bare)) | path.rlike("(?s)" + _whole("**/" + bare))
    return found


def ignore_predicate(path: Column, lines: Iterable[str]) -> Column:
    """Whether the lines of an ignore file exclude a path; a negated line wins wherever it stands."""
    clean = [x.strip() for x in lines]
    clean = [x for x in clean if x and not x.startswith("#")]
    normal = F.translate(path, "\\", "/")
    kept, dropped = F.lit(False), F.lit(False)
    for x in clean:
        if x.startswith("!"):
            kept = kept | _matched(normal, x[1:].strip())
        else:
            dropped = dropped | _matched(normal, x)
    return dropped & ~kept
