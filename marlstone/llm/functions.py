"""Functions and methods paired with their documentation.

Sources are lexed into rows of the tokens that matter: an opening (a bracket, or an indent in python), a closing, the head
of a function, a documentation comment, any other code. Windows do the rest: the running sum of openings and closings is
the depth; openings and closings of one depth alternate, so that the next row of the same depth closes a function; a
documentation comment belongs to the head that is the next row after it, a docstring to the head that is the row before.

Defined results: null ids, null and empty texts and contents give no row; kinds count in any case with blanks around;
repeated symbols, docstrings and texts are folded; a symbol has the signature of the head that the windows found in
the source at its file, name and line, else the one that its row gives, else its name alone is known. Other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.docwords import says_something
from marlstone.llm.lexing import spans
from marlstone.session import spread

_PY_HEAD = re.compile(r"(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]\n]*\])?\(")
# Where a statement or member may start, and the heads that start there; functions by their keyword are found anywhere.
_STARTS = re.compile(r"[;{}\n]")
_JS_FUNCTION = re.compile(r"function\b\s*\*?\s*(?P<a>[\w$]+)\s*\(")
_JS_BEFORE = re.compile(r"(?:\bexport\s+(?:default\s+)?)?(?:\basync\s+)?\Z")
_JS_HEAD = re.compile(
    r"[ \t]*(?:(?:export\s+)?(?:const|let|var)\s+(?P<b>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*\s*)?\(|(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*\*?(?P<c>(?!(?:if|for|while|switch|catch|return|function|with|await|new|typeof|else|do|super|import|throw|yield)\b)[\w$#]+)\s*(?:<[^()\n]*>)?\()"
)
_C_HEAD = re.compile(r"[ \t]*(?P<a>(?:[A-Za-z_]\w*[\s*]+)+?)(?P<c>[A-Za-z_]\w*)\s*\(")
_C_TAIL = re.compile(r"\s*(?=\{)")
_BRACKET = re.compile(r"[()\[\]{}]")
_TYPE_TAIL = re.compile(r"\s*(?::\s*[^={;]+?(?:\{[^{}]*\}[^={;]*?)?)?\s*(?:=>\s*)?(?=\{|=>)", re.S)


def _masked(text: str, found: list) -> str:
    """The text with comments and strings blanked, line breaks kept, so that places stay."""
    out, at = [], 0
    for sp in found:
        out += [text[at : sp.start], re.sub(r"[^\n]", " ", text[sp.start : sp.end])]
        at = sp.end
    return "".join([*out, text[at:]])


def _closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`, or -1."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in "([{":
            depth += 1
        elif text[i] in ")]}":
            depth -= 1
            if not depth:
                return i + 1
    return -1


def _nesting(line: str) -> int:
    return sum(1 if c in "([{" else -1 for c in _BRACKET.findall(line))


Token = tuple[int, int, str, int, str | None, str | None]  # place, line, kind, step of depth, name, text


def _thinned(toks: list[Token]) -> list[Token]:
    """One row for a run of other code: only that there is some matters to the neighbours."""
    return [t for k, t in enumerate(toks) if t[2] != "code" or not k or toks[k - 1][2] != "code"]


def python_tokens(text: str) -> list[Token]:
    found = spans("python", text)
    code = _masked(text, found)
    docs = {}
    for sp in found:
        if sp.kind == "docstring":
            docs.setdefault(text.count("\n", 0, sp.start), sp)
    out: list[Token] = []
    stack, at, line, depth, last = [0], 0, 0, 0, 0
    lines = code.split("\n")
    for k, raw in enumerate(lines):
        start, stop = at, at + len(raw)
        at = stop + 1
        line = k + 1
        bare = raw.strip()
        doc = docs.get(k)
        if doc is not None and code[start : doc.start].strip():
            doc = None
        if depth > 0 or not bare and doc is None:
            depth = max(0, depth + _nesting(raw))
            last = line if bare else last
            continue
        width = len(raw) - len(raw.lstrip()) if bare else doc.start - start
        while width < stack[-1]:
            stack.pop()
            out.append((start, last, "close", -1, None, None))
        if width > stack[-1]:
            stack.append(width)
            out.append((start, line, "open", 1, None, None))
        if doc is not None and not bare:
            out.append((doc.start, line, "doc", 0, None, doc.body))
            last = line + text.count("\n", doc.start, doc.end)
            continue
        m, last = _PY_HEAD.match(raw.lstrip()), line
        if m:
            begin = start + width
            close = _closing(code, begin + m.end() - 1)
            colon = code.find(":", close) if close > 0 else -1
            arrow = re.compile(r"\s*(?:->[^\n]*?)?:(?=\s|$)", re.S).match(code, close) if close > 0 else None
            colon = arrow.end() - 1 if arrow else colon
            out.append((begin, line, "head", 0, m[1], " ".join(text[begin : colon + 1 if colon > 0 else stop].split())))
            if colon > 0 and code[colon + 1 : stop if colon < stop else code.find("\n", colon) if "\n" in code[colon:] else len(code)].strip():  # the body is on the head's last line
                last = line + code.count("\n", begin, colon)
                out += [(begin + 1, last, "open", 1, None, None), (begin + 2, last, "close", -1, None, None)]
        else:
            out.append((start, line, "code", 0, None, None))
        depth = max(0, depth + _nesting(raw))
    out += [(len(text), last, "close", -1, None, None)] * (len(stack) - 1)
    return _thinned(out)


def brace_tokens(language: str, text: str) -> list[Token]:
    found = spans(language, text)
    code = _masked(text, found)
    breaks = [i for i, c in enumerate(code) if c == "\n"]
    line = lambda at: bisect_left(breaks, at) + 1
    out: list[Token] = [(sp.start, line(sp.start), "doc", 0, None, sp.body) for sp in found if sp.kind == "doc"]
    heads, inside = {}, []

    def head(begin: int, paren: int, name: str, tail_pattern: re.Pattern, braced: bool = False, arrow: bool = False) -> None:
        close = _closing(code, paren)
        tail = tail_pattern.match(code, close) if close > 0 else None
        if not tail or braced and code[tail.end() : tail.end() + 1] != "{" or arrow and "=>" not in code[close : tail.end() + 2] and "function" not in code[begin:paren]:
            return
        inside.append((paren, tail.end()))
        heads[begin] = (begin, line(begin), "head", 0, name, " ".join(text[begin : tail.end()].split()))

    for at in [0, *(m.end() for m in _STARTS.finditer(code))]:
        m = (_C_HEAD if language == "c" else _JS_HEAD).match(code, at)
        if m is None:
            continue
        begin = m.end() - len(m[0].lstrip())
        if language == "c":
            if not re.search(r"\b(?:return|else|typedef|goto|case)\b", m["a"]):
                head(begin, m.end() - 1, m["c"], _C_TAIL)
        elif m["b"]:
            head(begin, m.end() - 1, m["b"], _TYPE_TAIL, arrow=True)
        else:
            head(begin, m.end() - 1, m["c"], _TYPE_TAIL)
    if language != "c":
        for m in _JS_FUNCTION.finditer(code):
            if not code[m.start() - 1 : m.start()].isalnum():
                before = _JS_BEFORE.search(code, max(0, m.start() - 60), m.start())
                head(before.start(), m.end() - 1, m["a"], _TYPE_TAIL, braced=True)
    out += heads.values()
    inside.sort()
    last = -1
    for m in re.finditer(r"[{}]|[^\s{}][^{}\n]*", code):
        c = m.group()
        k = bisect_left(inside, (m.start() + 1,)) - 1
        if c in "{}" and k >= 0 and m.start() < inside[k][1]:
            continue  # a brace among parameters or in a result's type
        if c == "{":
            out.append((m.start(), line(m.start()), "open", 1, None, None))
        elif c == "}":
            out.append((m.start(), line(m.start()), "close", -1, None, None))
        elif m.start() not in heads and c.strip(" \t;") and (k := line(m.start())) != last:
            last = k
            out.append((m.start(), k, "code", 0, None, None))
    return _thinned(sorted(out, key=lambda t: (t[0], t[2] != "close")))


def tokens(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, language, key, pos, line, kind, step, name, body): the lexed tokens of each source file as rows."""
    lang = files.select(F.col("id").alias("file_id"), "language").where(F.col("language").isin("python", "javascript", "typescript", "c")).dropDuplicates(["file_id"])
    # Each row of a text is lexed by itself, so that texts needn't be shuffled to fold repeats; equal results are folded at the end.
    own = spread(texts.select("file_id", "content")).where(F.length("content") > 0).withColumn("key", F.monotonically_increasing_id()).join(lang, "file_id")

    def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, l, key, text in zip(b["file_id"], b["language"], b["key"], b["content"]):
                for k, (_, line, kind, step, name, body) in enumerate(python_tokens(text) if l == "python" else brace_tokens(l, text)):
                    out.append((i, l, key, k, line, kind, step, name, body))
            yield pd.DataFrame(out, columns=["file_id", "language", "key", "pos", "line", "kind", "step", "name", "body"])

    return own.select("file_id", "language", "key", "content").mapInPandas(lex, "file_id long, language string, key long, pos int, line int, kind string, step int, name string, body string")


def extract(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, name, start_line, end_line, signature, doc): every function with a body; doc is null where it has none."""
    order = Window.partitionBy("file_id", "key").orderBy("pos")
    rows = tokens(files, texts).withColumns({
        "depth": F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "before": F.lag("kind").over(order), "doc_before": F.lag("body").over(order),
        "after": F.lead("kind").over(order), "after2": F.lead("kind", 2).over(order), "doc_after2": F.lead("body", 2).over(order),
    })
    # Gaps and islands: an opening and its closing are neighbours among the rows of their level. A head's own opening is
    # the first of its level after it: heads, openings and closings of level depth + 1 stand in one order.
    level = F.when(F.col("kind") == "open", F.col("depth")).otherwise(F.col("depth") + 1)
    marks = rows.where(F.col("kind").isin("head", "open", "close")).withColumn("level", level)
    # Looking ahead is a running frame over the reverse order: linear, however many rows a level has.
    ahead = Window.partitionBy("file_id", "key", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    ended = marks.withColumn("end_line", F.last(F.when(F.col("kind") == "close", F.col("line")), ignorenulls=True).over(ahead))
    doc = F.when(F.col("language") == "python", F.when((F.col("after") == "open") & (F.col("after2") == "doc"), F.col("doc_after2"))).otherwise(F.when(F.col("before") == "doc", F.col("doc_before")))
    return ended.where((F.col("kind") == "head") & F.col("end_line").isNotNull()).select("file_id", "name", F.col("line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("body").alias("signature"), doc.alias("doc"))


def _says(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[says_something(c, n, s) for c, n, s in zip(b["content"], b["name"], b["signature"])]]


def documented(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, name, start_line, end_line, signature, content): functions of the sources with documentation that says something."""
    rows = extract(files, texts).where("doc is not null").withColumnRenamed("doc", "content").distinct()
    return rows.mapInPandas(_says, rows.schema)


def pairs(symbols: DataFrame, docstrings: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """(symbol_id, docstring_id, name, signature, content): the indexed functions and methods with each of their documentations that says something."""
    kind = F.lower(F.trim(F.regexp_replace("kind", r"\s+", " ")))
    own = symbols.where(kind.isin("function", "method") & F.col("id").isNotNull()).select(F.col("id").alias("symbol_id"), "file_id", "name", F.col("start_line").cast("long").alias("start_line"), F.nullif(F.trim("signature"), F.lit("")).alias("given")).dropDuplicates(["symbol_id"])
    heads = extract(files, texts).groupBy("file_id", "name", "start_line").agg(F.min("signature").alias("read"))
    known = own.join(heads, ["file_id", "name", "start_line"], "left").select("symbol_id", "name", F.coalesce("read", "given").alias("signature"))
    docs = docstrings.where("symbol_id is not null and content is not null").select(F.col("id").alias("docstring_id"), F.col("symbol_id").cast("long").alias("symbol_id"), "content").distinct()
    rows = docs.join(known, "symbol_id").select("symbol_id", "docstring_id", "name", "signature", "content")
    return rows.mapInPandas(_says, rows.schema)
