"""Tolerant lexing of python, javascript, typescript and c sources: comments and string literals with their places."""

from __future__ import annotations

import re
from typing import NamedTuple


class Span(NamedTuple):
    kind: str  # line, block, doc (a documentation comment), string, docstring
    start: int
    end: int
    body: str  # without marks, quotes and prefixes


_PY = re.compile(
    r"""(?P<line>\#[^\n]*)
    |(?P<triple>\b[rRbBuUfFtT]{0,2}(?P<q3>\"\"\"|''')(?:\\.|(?!(?P=q3)).)*(?P<e3>(?P=q3))?|(?P<q4>\"\"\"|''')(?:\\.|(?!(?P=q4)).)*(?P<e4>(?P=q4))?)
    |(?P<one>(?:\b[rRbBuUfFtT]{1,2})?(?:"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?))""",
    re.X | re.S,
)
_JS = re.compile(
    r"""(?P<line>//[^\n]*|\A\#![^\n]*)
    |(?P<block>/\*.*?(?:\*/|\Z))
    |(?P<one>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
    |(?P<tick>`)
    |(?P<regex>(?:(?<=[=(,:\[!&|?{};\n])|(?<=[=(,:\[!&|?{};]\ )|(?<=return\ ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)""",
    re.X | re.S,
)
_C = re.compile(
    r"""(?P<line>//(?:\\\r?\n|[^\n])*)
    |(?P<block>/\*.*?(?:\*/|\Z))
    |(?P<incl>\#[ \t]*include[^\n]*)
    |(?P<one>"(?:\\.|[^"\\\n])*"?)
    |(?P<char>'(?:\\.|[^'\\\n])*'?)""",
    re.X | re.S | re.M,
)
_HOLE = re.compile(r"\$\{")


def _template(text: str, at: int) -> int:
    """The end of the template literal that starts at `at`, holes and templates inside holes included."""
    i, depth, n = at + 1, [], len(text)
    while i < n:
        c = text[i]
        if not depth or depth[-1] == "`":
            if c == "\\":
                i += 1
            elif c == "`":
                if not depth:
                    return i + 1
                depth.pop()
            elif c == "$" and text[i : i + 2] == "${":
                depth.append("{")
                i += 1
        elif c == "`":
            depth.append("`")
        elif c == "{":
            depth.append("{")
        elif c == "}":
            depth.pop()
        elif c in "\"'":
            m = re.compile(r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?").match(text, i)
            i = m.end() - 1
        i += 1
    return n


def _template_body(s: str) -> str:
    out, i = [], 0
    while m := _HOLE.search(s, i):
        out.append(s[i : m.start()])
        d, j = 1, m.end()
        while j < len(s) and d:
            d += {"{": 1, "}": -1}.get(s[j], 0)
            j += 1
        out.append(" … ")
        i = j
    return "".join([*out, s[i:]])


def _python(text: str) -> list[Span]:
    out: list[Span] = []
    last = 0
    before = ""  # code between the last span and this one, to tell docstrings
    tail = ""
    for m in _PY.finditer(text):
        gap = text[last : m.start()]
        last = m.end()
        if gap.strip():
            tail = (tail + gap)[-400:]
        if m.lastgroup == "line" or m["line"] is not None:
            out.append(Span("line", m.start(), m.end(), m.group()[1:].strip()))
            continue
        s = m.group()
        body = s.lstrip("rRbBuUfFtT")
        q = body[:3] if body[:3] in ('"""', "'''") else body[:1]
        inner = body[len(q) :]
        closed = inner.endswith(q) and len(body) >= 2 * len(q)
        inner = inner[: -len(q)] if closed else inner
        line_start = text.rfind("\n", 0, m.start()) + 1
        alone = not text[line_start : m.start()].strip()
        prior = tail.rstrip()
        doc = alone and (not prior or prior.endswith(":") and re.search(r"(?:^|\n)[ \t]*(?:async[ \t]+def|def|class)\b[^\n]*(?:\n[^\n]*)*:\s*\Z", _last_block(prior)) is not None)
        out.append(Span("docstring" if doc else "string", m.start(), m.end(), inner))
        tail = (tail + " ''")[-400:]
    return out


def _last_block(code: str) -> str:
    """The last logical line: from the last def or class on."""
    k = max(code.rfind("\ndef "), code.rfind(" def "), code.rfind("\nclass "), code.rfind(" class "), code.rfind("\tdef "), 0 if code.startswith(("def ", "class ", "async ")) else -1)
    if k < 0:
        return ""
    block = code[k:]
    head = block.lstrip()
    # one logical line only: every line break inside must lie in brackets
    depth = 0
    for i, c in enumerate(head):
        depth += (c in "([{") - (c in ")]}")
        if c == "\n" and depth <= 0 and head[i:].strip():
            return ""
    return "\n" + head


#: The characters that a comment or literal can start with: only there the pattern is tried.
_MAY_START = re.compile(r"[\"'`/#]")


def _braced(text: str, pattern: re.Pattern) -> list[Span]:
    out: list[Span] = []
    i = 0
    while start := _MAY_START.search(text, i):
        m = pattern.match(text, start.start())
        if m is None:
            i = start.end()
            continue
        g = m.lastgroup
        i = m.end()
        if g == "line":
            out.append(Span("line", m.start(), m.end(), m.group()[2:].lstrip("/!").strip()))
        elif g == "block":
            s = m.group()
            doc = s.startswith("/**") and not s.startswith("/**/")
            body = re.sub(r"(?m)^[ \t]*\*(?!/)[ \t]?", "", s[2:-2] if s.endswith("*/") and len(s) >= 4 else s[2:])
            out.append(Span("doc" if doc else "block", m.start(), m.end(), body.strip()))
        elif g == "one":
            s = m.group()
            out.append(Span("string", m.start(), m.end(), s[1:-1] if len(s) > 1 and s[-1] == s[0] else s[1:]))
        elif g == "tick":
            i = _template(text, m.start())
            out.append(Span("string", m.start(), i, _template_body(text[m.start() + 1 : i - 1])))
    return out


def spans(language: str | None, text: str) -> list[Span]:
    """Comments and string literals in order; other languages have none."""
    if language == "python":
        return _python(text)
    if language in ("javascript", "typescript"):
        return _braced(text, _JS)
    if language == "c":
        return _braced(text, _C)
    return []
