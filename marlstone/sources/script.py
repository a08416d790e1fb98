"""JavaScript and TypeScript sources as rows: symbols, documentation, comments, imports, by a tolerant reading of their tokens.

One pass makes tokens and finds which bracket closes which; declarations are then read off the top level and out of class
bodies, jumping from bracket to bracket, so that nothing inside a function is looked at. A damaged text gives what can be
read from it. Symbols are functions, classes, methods, interfaces, type aliases, enums and variables of the top level; a
variable that holds an arrow function is a function. Overloads without a body, generators, abstract classes and members
with private names are no symbols.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.code import ROWS

_LEX = re.compile(
    r"""(?P<ws>\s+)|(?P<com>//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*)
    |(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<tick>`)
    |(?P<id>[#@]?[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<num>\.?\d[\w.]*)
    |(?P<p>=>|\.\.\.|\?\.|[=!<>]=+|&&|\|\||\?\?|\+\+|--|.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_PAIRS = {")": "(", "]": "[", "}": "{"}
_VALUE_AHEAD = frozenset("return typeof in of new delete void throw case do else yield await instanceof".split())
_MODIFIERS = frozenset("public private protected static override readonly abstract declare accessor".split())
_STARTS = frozenset("export function async class interface type enum const let var import declare abstract namespace module".split())


class Token(NamedTuple):
    kind: str  # id, str, num, tmpl, re, p
    v: str
    start: int
    end: int


def _template(text: str, at: int) -> int:
    """The end of the template that starts at `at`, holes included."""
    at += 1
    while at < len(text):
        at = _TEMPLATE.match(text, at).end()
        if text[at : at + 1] != "$":
            return min(len(text), at + 1)
        depth, at = 1, at + 2
        while at < len(text) and depth:
            c = text[at]
            if c == "`":
                at = _template(text, at)
                continue
            if c in "\"'":
                at = _LEX.match(text, at).end()
                continue
            depth += (c == "{") - (c == "}")
            at += 1
    return at


def tokens(text: str) -> tuple[list[Token], list[tuple[int, int]], dict[int, int]]:
    """(tokens, (start, end) of comments, opening -> closing token)."""
    out: list[Token] = []
    comments, closing, stack, at = [], {}, [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        kind, v, end = m.lastgroup, m.group(), m.end()
        if kind == "com":
            comments.append((at, end))
        elif kind != "ws":
            last = out[-1] if out else None
            if kind == "tick":
                kind, end = "tmpl", _template(text, at)
            elif v == "/" and (last is None or last.kind == "p" and last.v not in (")", "]", "}") or last.v in _VALUE_AHEAD) and (r := _REGEX.match(text, at)):
                kind, end = "re", r.end()
            elif kind == "p" and v in "([{":
                stack.append(len(out))
            elif kind == "p" and v in _PAIRS:
                # A bracket that nothing opens is skipped; one that closes an outer bracket ends those between.
                if any(out[k].v == _PAIRS[v] for k in stack):
                    while out[k := stack.pop()].v != _PAIRS[v]:
                        closing[k] = len(out)
                    closing[k] = len(out)
            out.append(Token(kind, text[at:end] if kind in ("str", "tmpl") else v, at, end))
        at = max(end, at + 1)
    for k in stack:
        closing[k] = len(out)
    return out, comments, closing


class Reader:
    def __init__(self, text: str, javascript: bool):
        self.text, self.javascript = text, javascript
        self.t, self.comments, self.closing = tokens(text)
        self.breaks = [m.end() for m in re.finditer("\n", text)]
        self.symbols: list[tuple[str, str, int, int, str | None, str]] = []
        self.imports: list[tuple[str, str, int, int, list[str]]] = []

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at) + 1

    def v(self, k: int) -> str:
        return self.t[k].v if k < len(self.t) else ""

    def kind(self, k: int) -> str:
        return self.t[k].kind if k < len(self.t) else ""

    def after(self, k: int) -> int:
        """The token after the one at k, or after what it opens."""
        return self.closing.get(k, k) + 1

    def put(self, name: str, kind: str, first: int, last: int, body: int | None, parent: str | None = None) -> None:
        start, end = self.t[first].start, self.t[min(last, len(self.t) - 1)].end
        head = self.text[start : self.t[body].start if body is not None and body < len(self.t) else end].rstrip()
        self.symbols.append((name, kind, self.line(start), self.line(max(start, end - 1)), parent, head))

    def body(self, k: int, stop: int) -> int | None:
        """The brace that opens the body behind the parameters that end before k; None where the declaration has none."""
        while k < stop:
            v = self.v(k)
            if v == "{" and self.v(k - 1) not in (":", "|", "&", "=>", "<", ",", "=", "is", "extends"):
                return k
            if v in (";", "=") or v == "}":
                return None
            k = self.after(k)
        return None

    def skip_angles(self, k: int) -> int:
        """Past type parameters."""
        if self.v(k) != "<":
            return k
        depth = 0
        while k < len(self.t):
            v = self.v(k)
            depth += (v == "<") - (v == ">")
            k = self.after(k)
            if depth == 0:
                break
        return k

    def statement_end(self, k: int, stop: int) -> int:
        """The last token of a statement without a block of its own: up to a semicolon, or a line that starts another."""
        while k < stop:
            if self.v(k) == ";":
                return k
            nxt = self.after(k)
            if nxt < stop and self.line(self.t[nxt].start) > self.line(self.t[nxt - 1].end - 1) and self.kind(nxt) in ("id", "str") and not self._hangs(nxt - 1):
                return nxt - 1
            k = nxt
        return stop - 1

    def _hangs(self, k: int) -> bool:
        """Whether what stands at the end of a line needs more."""
        t = self.t[k]
        return t.kind == "p" and t.v not in (")", "]", "}", ";", "++", "--", ">") or t.v in _VALUE_AHEAD

    def top(self) -> None:
        k, stop = 0, len(self.t)
        fresh = True
        while k < stop:
            if self.kind(k) == "id" and self.v(k) in _STARTS and (fresh or self.line(self.t[k].start) > self.line(self.t[k - 1].end - 1) and not self._hangs(k - 1)):
                if self.v(k) == "export":
                    k += 1
                    if self.v(k) == "default":
                        k += 1
                    fresh = True
                    continue
                k, fresh = self.declaration(k, stop), True
                continue
            if self.kind(k) == "id" and self.v(k)[0] == "@":
                k += 1
                while self.v(k) in (".", "(") or self.v(k - 1) == ".":
                    k = self.after(k)
                fresh = True
                continue
            nxt = self.after(k)
            fresh = self.v(k) == ";" or self.v(k) == "{" or self.v(k) == "}"
            k = nxt

    def declaration(self, k: int, stop: int) -> int:
        """Read a declaration; the place after it."""
        v, first = self.v(k), k
        if v == "declare" or v == "async" and self.v(k + 1) != "function":
            return k + 1
        if v in ("function", "async"):
            k += v == "async"
            generator = self.v(k + 1) == "*"
            name = k + 1 + generator
            if self.kind(name) != "id":
                return k + 1
            params = self.skip_angles(name + 1)
            if self.v(params) != "(":
                return name + 1
            body = self.body(self.after(params), stop)
            if body is None:
                return self.statement_end(self.after(params) - 1, stop) + 1
            if not generator:
                self.put(self.v(name), "function", first, self.closing[body], body)
            return self.closing[body] + 1
        if v == "abstract" and self.v(k + 1) == "class":
            body = self.class_body(k + 2, stop)
            return self.closing[body] + 1 if body is not None else k + 2
        if v == "class" and self.kind(k + 1) == "id":
            body = self.class_body(k + 2, stop)
            if body is None:
                return k + 2
            self.put(self.v(k + 1), "class", first, self.closing[body], body)
            self.members(body + 1, self.closing[body], self.v(k + 1))
            return self.closing[body] + 1
        if v == "interface" and self.kind(k + 1) == "id" or v == "enum" and self.kind(k + 1) == "id":
            body = k + 2
            while body < stop and self.v(body) != "{":
                body = self.skip_angles(body) if self.v(body) == "<" else body + 1
            if body < stop:
                self.put(self.v(k + 1), v, first, self.closing[body], body)
                return self.closing[body] + 1
            return k + 2
        if v == "const" and self.v(k + 1) == "enum":
            return self.declaration(k + 1, stop)
        if v == "type" and self.kind(k + 1) == "id" and self.v(self.skip_angles(k + 2)) == "=":
            last = self.statement_end(self.skip_angles(k + 2), stop)
            self.put(self.v(k + 1), "type_alias", first, last, None)
            return last + 1
        if v in ("const", "let", "var"):
            return self.variables(k + 1, stop)
        if v == "import" and self.v(k + 1) not in ("(", "."):
            return self.es_import(k, stop)
        return k + 1

    def class_body(self, k: int, stop: int) -> int | None:
        while k < stop:
            if self.v(k) == "{":
                return k
            k = self.skip_angles(k) if self.v(k) == "<" else self.after(k)
        return None

    def members(self, k: int, stop: int, parent: str) -> None:
        while k < stop:
            first = k
            while self.v(k) in _MODIFIERS and self.v(k + 1) not in ("(", "=", ";", ":", "?", "<"):
                k += 1
            if self.v(k) in ("async", "get", "set") and self.v(k + 1) not in ("(", "=", ";", ":", "?", "<"):
                k += 1
            if self.v(k) == "*":
                k += 1
            name, plain = self.v(k), self.kind(k) == "id" and self.v(k)[0] not in "#@"
            after = self.skip_angles(self.after(k) + (self.v(self.after(k)) == "?"))
            if self.kind(k) in ("id", "str", "num") and self.v(k)[:1] != "@" or self.v(k) == "[":
                if self.v(after) == "(":
                    body = self.body(self.after(after), stop)
                    if body is not None:
                        if plain:
                            self.put(name, "method", first, self.closing[body], body, parent)
                        k = self.closing[body] + 1
                        continue
                k = self.field_end(after, stop) + 1
                continue
            k = self.after(k)

    def field_end(self, k: int, stop: int) -> int:
        while k < stop:
            if self.v(k) == ";":
                return k
            nxt = self.after(k)
            if nxt < stop and self.line(self.t[nxt].start) > self.line(self.t[nxt - 1].end - 1) and not self._hangs(nxt - 1) and self.kind(nxt) != "p":
                return nxt - 1
            k = nxt
        return stop - 1

    def variables(self, k: int, stop: int) -> int:
        while k < stop:
            first, name, pattern = k, self.v(k), self.kind(k) != "id"
            k = self.after(k)
            k += self.v(k) == "!"
            if self.v(k) == ":":  # a type: up to the value
                while k < stop and self.v(k) not in ("=", ",", ";"):
                    k = self.skip_angles(k) if self.v(k) == "<" else self.after(k)
            value, body = None, None
            if self.v(k) == "=":
                value = k + 1
                body = self.arrow(value, stop)
            last = self.declarator_end(body if body is not None else value if value is not None else k - 1, stop)
            if not pattern:
                self.put(name, "function" if body is not None else "variable", first, last, body)
            if value is not None and self.javascript and self.v(value) == "require" and self.v(value + 1) == "(" and self.kind(value + 2) == "str":
                own = [t.v for t, u in zip(self.t[first : value - 1], self.t[first + 1 : value]) if t.kind == "id" and u.v != ":"]
                self.module(self.v(value + 2), first, last, own, False)
            k = last + 1
            if self.v(k) != ",":
                return k + (self.v(k) == ";")
            k += 1
        return k

    def arrow(self, k: int, stop: int) -> int | None:
        """The first token of an arrow function's body, None where the value is none."""
        k += self.v(k) == "async" and self.v(k + 1) != "=>"
        k = self.skip_angles(k)
        if self.v(k) == "(":
            k = self.after(k)
            if self.v(k) == ":":
                while k < stop and self.v(k) not in ("=>", ";"):
                    k = self.skip_angles(k) if self.v(k) == "<" else self.after(k)
        elif self.kind(k) == "id":
            k += 1
        return k + 1 if self.v(k) == "=>" else None

    def declarator_end(self, k: int, stop: int) -> int:
        while k < stop:
            nxt = self.after(k)
            if nxt >= stop or self.v(nxt) in (",", ";"):
                return min(nxt, stop) - 1
            if self.line(self.t[nxt].start) > self.line(self.t[nxt - 1].end - 1) and not self._hangs(nxt - 1) and self.kind(nxt) in ("id", "str", "num") and self.v(nxt) not in ("instanceof", "in", "as"):
                return nxt - 1
            k = nxt
        return stop - 1

    def es_import(self, k: int, stop: int) -> int:
        first, names, only_types = k, [], False
        k += 1
        if self.v(k) == "type" and self.v(k + 1) not in ("from", ","):
            only_types, k = True, k + 1
        while k < stop and self.kind(k) != "str":
            if self.v(k) in ("=", ";"):
                return k + 1
            if self.v(k) == "*" and self.v(k + 1) == "as":
                names.append("* as " + self.v(k + 2))
                k += 2
            elif self.v(k) == "{":
                j = k + 1
                while j < self.closing[k]:
                    j += self.v(j) == "type" and self.v(j + 1) not in (",", "}", "as")
                    names.append(self.v(j))
                    while j < self.closing[k] and self.v(j) != ",":
                        j += 1
                    j += 1
                k = self.closing[k]
            elif self.kind(k) == "id" and self.v(k) != "from":
                names.append(self.v(k))
            k += 1
        if k < stop:
            last = self.statement_end(k, min(stop, k + 2))
            self.module(self.v(k), first, k, names, only_types)
            return last + 1 if self.v(last) == ";" else k + 1
        return k

    def module(self, quoted: str, first: int, last: int, names: list[str], only_types: bool) -> None:
        name = quoted.strip("'\"")
        if name:
            kind = ("relative" if name.startswith(".") else "absolute") + (" type" if only_types else "")
            self.imports.append((name, kind, self.line(self.t[first].start), self.line(self.t[min(last, len(self.t) - 1)].start), names))


def clean_documentation(comment: str) -> str:
    """The text of a documentation comment without its marks, inner blank lines kept."""
    lines = [x.strip() for x in comment.split("\n")]
    lines = [x for k, x in enumerate(lines) if not (k and x.startswith("*/"))]
    lines = [re.sub(r"^/\*\*\s*", "", x) if x.startswith("/**") else re.sub(r"^\*\s*", "", x) for x in lines]
    return "\n".join(re.sub(r"\s*\*/$", "", x) for x in lines).strip("\n")


def rows_of(text: str, language: str) -> list[tuple]:
    """Rows of one text, as those of python sources: what, name, kind, lines, parent, text, level, names."""
    r = Reader(text, language == "javascript")
    r.top()
    out = [("symbol", n, k, a, b, p, head, None, None) for n, k, a, b, p, head in r.symbols]
    at = {}
    for n, k, a, b, p, _ in r.symbols:
        at.setdefault(a, (n, k, b, p))
    for start, end in r.comments:
        body, a, b = text[start:end], r.line(start), r.line(max(start, end - 1))
        if body.startswith("/**") and body != "/**/":
            own = at.get(b) or at.get(b + 1) or (None, None, None, None)
            out.append(("docstring", own[0], own[1], a, b, own[3], clean_documentation(body), None, None))
        else:
            out.append(("comment", None, None, a, a, None, body.removeprefix("//").removeprefix("/*").removesuffix("*/").strip(), None, None))
    return out + [("import", n, k, a, b, None, None, 0, names) for n, k, a, b, names in r.imports]


def parse_script(texts: DataFrame, id_col: str, text: str, language: str) -> DataFrame:
    """(id, what, ...) rows of texts of one language."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["id", "what", "name", "kind", "start_line", "end_line", "parent", "text", "level", "names"]
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, t in zip(b["id"], b["text"]) for r in rows_of(t, language)], columns=cols)

    return texts.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null").mapInPandas(run, f"id {kind}, {ROWS}")
