"""Metrics of functions in languages with braces, from patterns and brace matching. Runs inside Arrow workers."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

# Extensions, header patterns in their order, names that are no functions,
# patterns that count as decisions (overlaps count twice), words that weigh on a reader.
EXTENSIONS = {".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".java": "java", ".go": "go", ".rs": "rust"}
_SCRIPT_HEADERS = (
    r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)",
    r"(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)\s*(?::\s*[^{]+?)?\s*\{",
    r"(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+?)?\s*=\s*(?:async\s+)?(?:\(([^)]*)\)|\w+)\s*(?::\s*[^=]+?)?\s*=>\s*\{",
)
_JAVA_HEADER = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?(?:\w+(?:\[\])?(?:<[^>]+>)?)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w\s,]+?)?\s*\{"
_GO_HEADER = r"func\s+(?:\(\s*\w+\s+\*?\w+(?:\.\w+)?\s*\)\s+)?(\w+)\s*\(([^)]*)\)"
_RUST_HEADER = r"(?:pub(?:\([\w:]+\))?\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)"
_SCRIPT_SKIP = frozenset({"if", "for", "while", "switch", "catch", "return", "import", "from", "class", "new", "throw", "else"})
_JAVA_SKIP = frozenset({"if", "for", "while", "switch", "catch", "class", "new", "return", "throw", "import", "package"})
_DECISIONS = (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\?\?", r"\?[^?]", r"&&", r"\|\|")
_MORE_DECISIONS = {"go": (r"\bselect\b", r"\bdefer\b.*\bfunc\b"), "rust": (r"\bmatch\b", r"\bif\s+let\b", r"\bwhile\s+let\b", r"\bloop\b"), "java": (r"\binstanceof\b",)}
_WORDS = ("if", "for", "while", "switch", "catch")
_MORE_WORDS = {"go": ("select",), "rust": ("match", "loop")}


@dataclass(frozen=True)
class Grammar:
    name: str
    headers: tuple[re.Pattern, ...]
    skip: frozenset[str] = frozenset()
    once_a_line: bool = False
    receiver: frozenset[str] = frozenset()
    decisions: tuple[re.Pattern, ...] = ()
    words: re.Pattern = re.compile("")


def _grammar(name: str, headers: tuple[str, ...], **more) -> Grammar:
    counted = tuple(re.compile(p) for p in _DECISIONS + _MORE_DECISIONS.get(name, ()))
    words = re.compile(r"\b(?:" + "|".join(_WORDS + _MORE_WORDS.get(name, ())) + r")\b")
    return Grammar(name, tuple(re.compile(h, re.MULTILINE) for h in headers), decisions=counted, words=words, **more)


_SCRIPT = _grammar("javascript", _SCRIPT_HEADERS, skip=_SCRIPT_SKIP, once_a_line=True)
GRAMMARS = {"javascript": _SCRIPT, "typescript": _SCRIPT, "java": _grammar("java", (_JAVA_HEADER,), skip=_JAVA_SKIP), "go": _grammar("go", (_GO_HEADER,)), "rust": _grammar("rust", (_RUST_HEADER,), receiver=frozenset({"self", "&self", "&mut self"}))}
_BRACE = re.compile(r"[{}]")
_MARKS = re.compile(r"[{}\"'`]")


def _braces(text: str, start: int = 0):
    """(place, sign) of every brace outside strings, where a quote after a backslash does not end a string."""
    quote, at = "", start
    while m := _MARKS.search(text, at):
        at, sign = m.end(), m.group()
        if quote:
            if sign == quote and (m.start() == start or text[m.start() - 1] != "\\"):
                quote = ""
        elif sign in "\"'`":
            quote = sign
        else:
            yield m.start(), sign


def body_of(source: str, start: int) -> tuple[str, int]:
    """(text, place of its last brace) from the first { to its match; without a match all the rest."""
    opening = source.find("{", start)
    if opening < 0:
        return "", start
    depth = 0
    for at, sign in _braces(source, opening):
        depth += 1 if sign == "{" else -1
        if depth == 0:
            return source[opening : at + 1], at
    return source[opening:], len(source)


def decisions(body: str, language: str) -> int:
    return 1 + sum(len(p.findall(body)) for p in GRAMMARS[language].decisions)


def nesting(body: str) -> int:
    depth = deepest = 0
    for _, sign in _braces(body):
        depth = depth + 1 if sign == "{" else max(0, depth - 1)
        deepest = max(deepest, depth)
    return max(0, deepest - 1)


def cognitive(body: str, language: str) -> int:
    """Words weigh 1 and the depth before their line's braces; && and || weigh 1."""
    words = GRAMMARS[language].words
    total = depth = 0
    for line in map(str.strip, body.splitlines()):
        if not line or line.startswith(("//", "/*")):
            continue
        total += len(words.findall(line)) * (1 + depth) + line.count("&&") + line.count("||")
        for sign in _BRACE.findall(line):
            depth = depth + 1 if sign == "{" else max(0, depth - 1)
    return total


def functions(source: str, language: str) -> list[tuple[str, int, int, int, int, int, int, int]]:
    """(name, line, end_line, length, cyclomatic, max_nesting, cognitive, params), header pattern by header pattern."""
    grammar = GRAMMARS[language]
    breaks = [m.start() for m in re.finditer("\n", source)]
    line_at = lambda at: bisect.bisect_left(breaks, at) + 1
    found, taken = [], set()
    for header in grammar.headers:
        for m in header.finditer(source):
            line = line_at(m.start())
            if grammar.once_a_line:
                if line in taken:
                    continue
                taken.add(line)
            if m[1] in grammar.skip:
                continue
            body, last = body_of(source, m.start())
            length = line_at(last) - line + 1
            if not body or length < 2:
                continue
            named = [p.strip() for p in (m[2] or "").split(",")]
            params = sum(1 for p in named if p and p not in grammar.receiver)
            found.append((m[1], line, line_at(last), length, decisions(body, grammar.name), nesting(body), cognitive(body, grammar.name), params))
    return found
