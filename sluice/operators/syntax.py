"""Signatures and skeletons of Python sources by their syntax tree; what doesn't parse is left to the line patterns.

A file is one value, so each is parsed once in an Arrow batch; rows of the
result are exploded by built-in functions.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a body from which on a skeleton folds it.
LEAST = 3
NODE = "array<struct<line_no: int, depth: int, kind: string, name: string, signature: string, body_first: int, body_last: int>>"


def _tree(text: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def definitions(text: str | None) -> list[tuple] | None:
    """(line from 0, depth, kind, name, signature, first and last line of the body) of each definition; None: doesn't parse."""
    tree = _tree(text)
    if tree is None:
        return None
    own, found, stack = (text or "").splitlines(), [], [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        inner = depth
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = depth + 1
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if depth and found_class(node, tree) else "function"
            first, at = node.body[0], node.lineno - 1
            head = own[at : max(at + 1, first.lineno - 1)] if first.lineno - 1 > at else [own[at]]
            signature = " ".join(x.strip() for x in head if x.strip() and not x.strip().startswith(("#", "@")))
            if first.lineno - 1 == at:  # the body on the line of its head
                signature = own[at].encode()[: first.col_offset].decode(errors="ignore").strip()
            found.append((at, depth, kind, node.name, signature, max(at + 1, first.lineno - 1), node.end_lineno - 1))
        stack += [(child, inner) for child in ast.iter_child_nodes(node)]
    return sorted(found)


def found_class(node: ast.AST, tree: ast.Module) -> bool:
    """Whether a definition is an immediate part of a class."""
    if not hasattr(tree, "_owners"):
        tree._owners = {id(c): p for p in ast.walk(tree) for c in ast.iter_child_nodes(p)}
    return isinstance(tree._owners.get(id(node)), ast.ClassDef)


def skeleton(text: str | None, least: int = LEAST) -> str | None:
    """The text with the bodies of outermost functions and of methods folded, from ``least`` lines on; None: doesn't parse."""
    found = definitions(text)
    if found is None:
        return None
    own, out, at = (text or "").split("\n"), [], 0
    for _, _, kind, _, _, first, last in found:
        if kind == "class" or first < at or last - first + 1 < least:
            continue
        indent = own[first][: len(own[first]) - len(own[first].lstrip())]
        out += [*own[at:first], f"{indent}... ({last - first + 1} lines collapsed)"]
        at = last + 1
    return "\n".join([*out, *own[at:]])


def signatures(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no, depth, kind, name, signature), a row a definition; texts that don't parse have none."""

    @F.pandas_udf(NODE)
    def run(s: pd.Series) -> pd.Series:
        names = ("line_no", "depth", "kind", "name", "signature", "body_first", "body_last")
        return s.map(lambda t: [dict(zip(names, d)) for d in definitions(t) or []])

    each = docs.select(doc, F.explode(run(F.col(text))).alias("d"))
    return each.select(doc, *[f"d.{c}" for c in ("line_no", "depth", "kind", "name", "signature")])


def skeletons(text: Column) -> Column:
    """The skeleton, or null where the text doesn't parse."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(skeleton)

    return run(text)
