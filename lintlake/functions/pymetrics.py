"""Metrics and checks of Python functions from the syntax tree. Runs inside Arrow workers."""

from __future__ import annotations

import ast
from collections.abc import Iterator

# Which nodes add a path, deepen the nesting, or weigh on a reader.
_PATHS = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.BoolOp)
_DEEPER = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.ExceptHandler)
_HEAVY = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)

Metrics = tuple[str, int, int, int, int, int, int, int]


def _measured(function: ast.AST) -> Metrics:
    """(name, line, end_line, length, cyclomatic, max_nesting, cognitive, params), in one walk with an explicit stack."""
    paths = 1
    deepest = weight = 0
    stack = [(child, 0, 0) for child in ast.iter_child_nodes(function)]
    while stack:
        node, depth, burden = stack.pop()
        if isinstance(node, _PATHS):
            paths += 1
        if isinstance(node, ast.BoolOp):
            paths += len(node.values) - 1
            weight += 1
        if isinstance(node, _DEEPER):
            depth += 1
            deepest = max(deepest, depth)
        if isinstance(node, _HEAVY + _FUNCTION):
            weight += 1 + burden
            burden += 1
        stack.extend((child, depth, burden) for child in ast.iter_child_nodes(node))
    a = function.args
    params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)
    if a.args and a.args[0].arg in ("self", "cls"):
        params -= 1
    end = function.end_lineno or function.lineno
    return function.name, function.lineno, end, end - function.lineno + 1, paths, deepest, weight, params


def _preorder(node: ast.AST) -> Iterator[ast.AST]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


def functions(source: str) -> list[Metrics]:
    """All functions and methods in source order; a text that does not parse has none."""
    try:
        return [_measured(n) for n in _preorder(ast.parse(source)) if isinstance(n, _FUNCTION)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def checks(source: str, wanted: frozenset[str]) -> list[tuple[str, int, str]]:
    """(check, line, detail) of the syntax-tree rules, in source order."""
    found = []
    try:
        nodes = list(_preorder(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    for n in nodes:
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("eval", "exec"):
            found.append((f"no-{n.func.id}", n.lineno, f"call of {n.func.id}"))
        elif isinstance(n, ast.ImportFrom) and n.names and n.names[0].name == "*":
            found.append(("no-star-import", n.lineno, n.module or "unknown"))
        elif isinstance(n, _FUNCTION) and any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*n.args.defaults, *n.args.kw_defaults]):
            found.append(("no-mutable-default", n.lineno, n.name))
        elif isinstance(n, ast.ExceptHandler) and n.type is None:
            found.append(("no-bare-except", n.lineno, "bare except"))
        elif isinstance(n, ast.Global):
            found.append(("no-global", n.lineno, ", ".join(n.names)))
    return [f for f in found if f[0] in wanted]
