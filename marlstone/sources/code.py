"""Python sources as rows: symbols, docstrings, comments, imports, references, from the standard library's parser."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "what string, name string, kind string, start_line int, end_line int, parent string, text string, level int, names array<string>"


def _parse(text: str) -> ast.Module | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text.removeprefix("﻿"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def signature(node: ast.stmt, lines: list[str]) -> str:
    """The text from the node's own line to where its body starts."""
    first = node.body[0]
    end = first.lineno - 1 if first.lineno > node.lineno else node.lineno
    head = "\n".join(lines[node.lineno - 1 : end])
    if first.lineno == node.lineno:
        head = lines[node.lineno - 1].encode()[: first.col_offset].decode("utf-8", "ignore")
    depth, out = 0, []
    for k, c in enumerate(head):
        depth += (c in "([{") - (c in ")]}")
        out.append(c)
        if c == ":" and depth == 0 and k > 3:
            break
    return " ".join("".join(out).split())


def _names(body: list[ast.stmt]) -> Iterator[tuple[str, int, int]]:
    for n in body:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name):
                yield t.id, n.lineno, n.end_lineno


def _used(node: ast.AST) -> Iterator[tuple[str, str]]:
    """(name, kind) used inside a function, nested definitions aside."""
    stack = list(ast.iter_child_nodes(node))
    called = set()
    while stack:
        n = stack.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        if isinstance(n, ast.Call):
            called.add(id(n.func))
            if isinstance(n.func, ast.Name):
                yield n.func.id, "call"
            elif isinstance(n.func, ast.Attribute):
                yield n.func.attr, "call"
        elif isinstance(n, ast.Attribute) and id(n) not in called:
            yield n.attr, "attribute"
        elif isinstance(n, ast.Name) and id(n) not in called:
            yield n.id, "name"
        stack.extend(ast.iter_child_nodes(n))


def rows_of(text: str) -> list[tuple]:
    """Rows of one python text; a text that doesn't parse has none. Functions inside functions are no symbols."""
    tree = _parse(text)
    if tree is None:
        return []
    lines, out = text.replace("\r\n", "\n").split("\n"), []
    doc = ast.get_docstring(tree, clean=True)
    if doc:
        out.append(("docstring", None, None, 1, 1, None, doc, None, None))

    def define(node: ast.stmt, kind: str, parent: str | None) -> None:
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        out.append(("symbol", node.name, kind, start, node.end_lineno, parent, signature(node, lines), None, None))
        text_ = ast.get_docstring(node, clean=True)
        if text_:
            out.append(("docstring", node.name, kind, start, node.end_lineno, parent, text_, None, None))
        if kind != "class":
            for name, use in sorted(set(_used(node))):
                if name != node.name:
                    out.append(("reference", name, use, start, node.end_lineno, node.name, None, None, None))

    def imports(body: list[ast.stmt]) -> None:
        for n in body:
            if isinstance(n, ast.Import):
                for a in n.names:
                    out.append(("import", a.name, "absolute", n.lineno, n.end_lineno, None, None, 0, []))
            elif isinstance(n, ast.ImportFrom):
                out.append(("import", n.module or "", "relative" if n.level else "absolute", n.lineno, n.end_lineno, None, None, n.level, [a.name for a in n.names]))
            elif isinstance(n, (ast.If, ast.Try)):
                for part in ("body", "orelse", "finalbody"):
                    imports(getattr(n, part, []))
                for h in getattr(n, "handlers", []):
                    imports(h.body)

    imports(tree.body)
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            define(n, "function", None)
        elif isinstance(n, ast.ClassDef):
            define(n, "class", None)
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    define(m, "method", n.name)
    out += [("symbol", v, "variable", a, b, None, None, None, None) for v, a, b in _names(tree.body)]
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                out.append(("comment", None, None, t.start[0], t.start[0], None, t.string.lstrip("#").strip(), None, None))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


def parse_python(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, what, ...) rows of python texts."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["id", "what", "name", "kind", "start_line", "end_line", "parent", "text", "level", "names"]
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, t in zip(b["id"], b["text"]) for r in rows_of(t)], columns=cols)

    return texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null").mapInPandas(run, f"id {kind}, {ROWS}")


def masked(text: str) -> str | None:
    """The text without comments, docstrings, trailing blanks and blank lines; None where it doesn't parse."""
    tree = _parse(text)
    if tree is None:
        return None
    lines = text.split("\n")
    drop: set[int] = set()
    for n in ast.walk(tree):
        if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and n.body:
            first = n.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                drop.update(range(first.lineno, first.end_lineno + 1))
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                lines[t.start[0] - 1] = lines[t.start[0] - 1][: t.start[1]]
    except (tokenize.TokenError, IndentationError):
        return None
    return "\n".join(x.rstrip() for k, x in enumerate(lines, 1) if k not in drop and x.strip())


def docs_only(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """`pairs` with docs_only: whether an edit of a python text touched nothing but documentation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(docs_only=[(m := masked(x)) is not None and m == masked(y) for x, y in zip(b[before], b[after])])

    return pairs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", docs_only boolean")


def parse(texts: DataFrame, language: str, id_col: str, text: str) -> DataFrame:
    """Dispatch by language; one without a parser has files but no symbols."""
    from marlstone.sources.script import parse_script

    if language == "python":
        return parse_python(texts, id_col, text)
    if language in ("javascript", "typescript"):
        return parse_script(texts, id_col, text, language)
    raise ValueError(f"no parser for {language}")
