"""Blocks and measures of Python source, from its syntax tree."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame

_BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert)
FUNCTIONS = "path string, qualified_name string, class_name string, start_line int, end_line int, complexity int, docstring string, content string"


def _found(node: ast.AST, owner: str | None):
    """Functions in a body, each with its innermost class: also those in bodies of statements there, never in else or handlers,
    and directly in functions."""
    for child in getattr(node, "body", None) or []:
        if isinstance(child, ast.ClassDef):
            yield from _found(child, child.name)
        elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
            yield child, owner
            inner = [x for x in child.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
            yield from _found(ast.Module(inner, []), owner)
        elif isinstance(child, ast.stmt):
            yield from _found(child, owner)


def _rows(path: str, text: str | None) -> list[tuple]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # no Python, or too deep: no blocks
        return []
    lines, out = (text or "").split("\n"), []
    for f, owner in _found(tree, None):
        begin = min([f.lineno, *[d.lineno for d in f.decorator_list]]) - 1
        name = f"{owner}::{f.name}" if owner else f.name
        measure = 1 + sum(isinstance(x, _BRANCHES) for x in ast.walk(f))
        body = "\n".join(lines[begin : f.end_lineno])
        out.append((path, name, owner, begin, f.end_lineno - 1, measure, ast.get_docstring(f), f"# {path}::{name}\n\n{body}"))
    return out


def functions(sources: DataFrame) -> DataFrame:
    """One block for each function of sources (path, text): bounds 0-based, decorators inside.

    Nested functions are blocks of their own too. Texts that don't parse, null texts and files without
    functions give none. `complexity` is 1 and one for each branch, loop, handler, with and assert.
    """
    names = [x.split()[0] for x in FUNCTIONS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for p, t in zip(batch["path"], batch["text"], strict=True) for r in _rows(p, t)]
            yield pd.DataFrame(rows, columns=names)

    return sources.select("path", "text").mapInPandas(run, FUNCTIONS)
