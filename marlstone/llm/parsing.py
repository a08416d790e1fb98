"""Source files that do not parse, and their rate per repository and language.

A file is cut at line ends into chunks. A worker turns a chunk into a map from each lexer state it may start in to the state
it ends in, with a bracket summary (the closings that need an opening before the chunk, and the openings that stay open) and
the facts that later code depends on (directives and type names of C). Maps compose associatively: the chunks of a group are
folded by the worker that made their maps, the groups of a file by another, and every group gets the state, the open brackets
and the facts it starts with. From there the balanced statements of the top level are cut out and parsed by local grammars:
Python's own compiler, and grammars of modules, TypeScript and C. A statement that a group cuts is put together again by
windows. A text of one chunk takes the same steps in one worker.

Statements carry what binds them: the place of future statements, names declared global, exports, macros, conditionals.
Where all hold, the file is valid: each statement starts and ends between tokens. Where one fails, or the brackets of the
file don't close, the exact check follows, as the lexer states know no nested templates, no quotes inside replacement fields
and no code inside macros: the file is parsed as a whole, whatever its size. The result doesn't depend on the chunk size.

Defined results: language text, knowledge_base rows, null languages and null texts never count; an empty text is valid; a
file comes once however often its rows are repeated, and counts where any of its texts is broken; files without a text are
counted as files, not as errors.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import grammar_c, grammar_js
from marlstone.llm.grammar_js import Invalid
from marlstone.session import cut, spread

LANGUAGES = ("python", "javascript", "typescript", "c")
CHUNK = 8192
STATEMENTS = 1024  # characters that are handed to a grammar at once, where statements are smaller
GROUP = 64  # chunks that one worker folds and walks

_OPENERS, _PAIR = "([{", {")": "(", "]": "[", "}": "{"}
# The states in which a line may start, by language.
STATES = {"python": ("N", "'''", '"""', "'", '"'), "javascript": ("N", "/*", "`", "'", '"'), "typescript": ("N", "/*", "`", "'", '"'), "c": ("N", "/*", "'", '"', "//")}
_IN = r"[^()\[\]{}\"'`#/\\\n]*"
_FLAT = rf"\({_IN}\)|\[{_IN}\]|\{{{_IN}\}}|"  # brackets that close on their line with nothing inside that matters
_SCAN = {
    "python": re.compile(_FLAT + r"#[^\n]*|(?:\"\"\"|''')|[\"'()\[\]{}]|\\."  , re.S),
    "javascript": re.compile(_FLAT + r"//[^\n]*|/\*|[\"'`()\[\]{}]|(?:(?<=[=(,:\[!&|?{};\n])|(?<=[=(,:\[!&|?{};] )|(?<=return ))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"),
    "c": re.compile(_FLAT + r"//|/\*|^[ \t]*#(?:\\\r?\n|[^\n])*|[\"'()\[\]{}]", re.M),
}
_SCAN["typescript"] = _SCAN["javascript"]
_ENDS = {
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S), '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S), "/*": re.compile(r".*?\*/", re.S),
    "'": re.compile(r"(?:[^'\\\n]|\\(?:\r\n|.))*(?P<q>')?", re.S), '"': re.compile(r'(?:[^"\\\n]|\\(?:\r\n|.))*(?P<q>")?', re.S), "//": re.compile(r"(?:\\\r?\n|[^\n])*"), "`": re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S),
}

Summary = tuple[str, str, str, str]  # end state, closings, openings ($ for a template's hole, ` for a template), facts


def scan(language: str, text: str, state: str, places: list[tuple[int, int, int]] | None = None) -> Summary:
    """What a chunk does from a state on. `places` gets (line start, closings so far, openings) of lines that start in code."""
    closed, open_, facts, at, n = [], [], [], 0, len(text)
    pattern = _SCAN[language]
    lines = [m.end() for m in re.finditer("\n", text)] if places is not None else []
    mark, many = 0, len(lines)
    done = lambda: (state, "".join(closed), "".join(open_), "".join(facts))

    def note(upto: int, code: bool) -> None:
        nonlocal mark
        while mark < len(lines) and lines[mark] <= upto:
            if code:
                places.append((lines[mark], len(closed), len(open_)))
            mark += 1

    while at < n or state == "`":
        if state != "N":
            m = _ENDS[state].match(text, at)
            if state == "`":
                at = m.end()
                note(at, False)
                if at >= n:
                    break
                if text[at] == "`":
                    at += 1
                    if open_ and open_[-1] == "`":
                        open_.pop()
                    else:
                        closed.append("`")
                else:  # a hole
                    open_.append("$")
                    at += 2
                state = "N"
                continue
            if m is None:
                note(n, False)
                return done()
            end = m.end()
            if state in ("'", '"') and m["q"] is None and end >= n and re.search(r"\\\r?\n\Z", text):
                note(n, False)
                return done()
            if state == "//" and end >= n and re.search(r"\\\r?\n\Z", text):
                return done()
            note(end - 1, False)
            at, state = end, "N"
            continue
        m = pattern.search(text, at)
        if m is None:
            note(n, True)
            at = n
            break
        if mark < many and lines[mark] <= m.start():
            note(m.start(), True)
        v, at = m.group(), m.end()
        if len(v) > 1 and v[0] in _OPENERS:
            continue
        if v in ("'''", '"""', "/*", "'", '"') or v == "//" and language == "c":
            state = v
        elif v == "`":
            open_.append("`")
            state = "`"
        elif v in _OPENERS:
            open_.append(v)
        elif v.lstrip(" \t")[0] == "#" and language == "c":
            facts.append(v.strip() + "\n")
        elif v in _PAIR:
            if not open_:
                closed.append(v)
            elif open_[-1] == _PAIR[v]:
                open_.pop()
            elif v == "}" and open_[-1] == "$":
                open_.pop()
                state = "`"
            else:
                open_.append(v)  # never matched: the fold finds it
    note(n, state == "N")
    return done()


def state_map(language: str, text: str) -> dict[str, Summary]:
    types = _types(language, text)
    return {s: (*r[:3], r[3] + types) for s in STATES[language] if (r := scan(language, text, s))}


def _types(language: str, text: str) -> str:
    return "".join(f"typedef int {x};\n" for x in grammar_c.type_names(text)) if language == "c" else ""


def pushed(stack: str, closed: str, open_: str) -> str | None:
    """The open brackets after a chunk, None where a closing doesn't fit: also a brace that closes a template's hole in a later chunk."""
    k = len(closed)
    if k > len(stack) or any(x != _PAIR.get(c, c) for x, c in zip(reversed(stack), closed)):
        return None
    return stack[: len(stack) - k] + open_


def compose(a: dict[str, Summary], b: dict[str, Summary]) -> dict[str, Summary]:
    """The map of two neighbouring stretches; associative. A mismatch stays visible as `!` among the closings."""
    out = {}
    for s, (end, closed, open_, facts) in a.items():
        end2, closed2, open2, facts2 = b[end]
        stack, more = list(open_), []
        for k, c in enumerate(closed2):
            if not stack:
                more = list(closed2[k:])
                break
            top = stack.pop()
            if not (c in _PAIR and top == _PAIR[c] or c == top == "`"):
                more = ["!", *closed2[k:]]  # also a brace that closes a template's hole: only the whole text can tell
                break
        out[s] = (end2, closed + "".join(more), "".join(stack) + open2, facts + facts2)
    return out


_NEXT = {
    "python": re.compile(r"(?!(?:else|elif|except|finally|case)\b)[^\s#)\]}]"),
    "javascript": re.compile(r"(?:import|export|function|class|const|let|var|async|interface|type|enum|declare|abstract|namespace|if|for|switch|try)\b|/[/*]"),
    "c": re.compile(r"(?:static|int|void|char|struct|typedef|const|extern|unsigned|signed|long|short|float|double|enum|union|size_t|inline)\b|/[/*]"),
}
_NEXT["typescript"] = _NEXT["javascript"]


def cuts(language: str, text: str, places: list[tuple[int, int, int]], depth: int) -> list[int]:
    """Where statements of the top level start in a chunk, given the places that a scan noted and the depth at its start."""
    out = []
    starts = _NEXT[language].match
    for at, closed, open_ in places:
        if open_ or closed != depth or at >= len(text) or not starts(text, at):
            continue
        before = text[max(0, at - 400) : at].rstrip()
        if language == "python":
            if before.endswith("\\") or re.match(r"@", before.rsplit("\n", 1)[-1]):
                continue
        elif not before.endswith((";", "}")):
            continue
        out.append(at)
    return out


_FAILURES = (SyntaxError, ValueError, MemoryError, RecursionError, OverflowError, Invalid)


def _compile(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        compile(text.removeprefix("\ufeff"), "<file>", "exec", dont_inherit=True)


def is_valid(language: str, text: str) -> bool:
    """The exact check: whether a whole text is valid."""
    try:
        if language == "python":
            _compile(text)
        elif language == "c":
            grammar_c.parse(text)
        else:
            grammar_js.parse(text, language == "typescript")
    except _FAILURES:
        return False
    return True


_FUTURE = re.compile(r"(?m)^\s*from\s+__future__\b")
_MAYBE_HEAD = re.compile(r"\s*(?:from\s+__future__\b|[rRuU]?['\"]|#|\Z)")


def _head(text: str) -> bool:
    """Whether statements are such as may stand before future statements: a documentation string, future statements."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        body = ast.parse(text.removeprefix("\ufeff")).body
    return all(isinstance(x, ast.ImportFrom) and x.module == "__future__" or k == 0 and isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str) for k, x in enumerate(body))


def _declares_global(text: str) -> bool:
    """Whether `global` stands outside of functions and classes: names used before then count against it."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        left: list[ast.AST] = [ast.parse(text.removeprefix("\ufeff"))]
    while left:
        node = left.pop()
        if isinstance(node, ast.Global):
            return True
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.expr)):
            left += ast.iter_child_nodes(node)
    return False


class Judge:
    """Parses the statements of a file, from some place on, by local grammars, with the facts of those before."""

    def __init__(self, language: str, first: bool, env: str | None):
        self.language, self.first = language, first
        self.bad = False
        self.before: list[str] | None = [] if first else None  # python: what may stand before future statements, if it still may be
        self.exports: list[str] = []
        self.env = grammar_c.Env() if language == "c" else None
        if env:
            self.pass_over(env)

    def pass_over(self, facts: str) -> None:
        if self.env is not None:
            try:
                self.env.skim(facts)
            except Invalid:
                self.bad = True

    def see(self, text: str) -> None:
        if self.bad or not text:
            return
        first, self.first = self.first, False
        try:
            if self.language == "c":
                grammar_c.parse(text, self.env)
            elif self.language != "python":
                self.exports += grammar_js.parse(text, self.language == "typescript", first)
            elif not first and text.startswith("\ufeff"):
                self.bad = True
            else:
                _compile(text)
                if not first and "__future__" in text and _FUTURE.search(text):
                    self.bad = self.before is None or not _head("".join(self.before))
                if self.before is not None:
                    self.before = [*self.before, text] if _MAYBE_HEAD.match(text) else None
                if not first and "global" in text and _declares_global(text):
                    self.bad = True
        except _FAILURES:
            self.bad = True


class Walk:
    """Goes over chunks from a known state on and hands whole statements to a judge; what the borders cut is kept."""

    def __init__(self, language: str, state: str = "N", stack: str = "", env: str | None = None, first: bool = True, grouped: bool = False):
        self.grouped = grouped
        self.language, self.state, self.stack = language, state, stack
        self.begun, self.facts = state, env or ""  # facts of the statements that are done; a text of one chunk needs none
        self.judge = Judge(language, first, env)
        self.head: str | None = None if first else ""  # the end of a statement that starts before
        self.parts: list[str] = []  # of the statement that goes on
        self.stopped = False

    def feed(self, text: str) -> None:
        if self.stopped:
            return
        places: list[tuple[int, int, int]] = []
        self.state, closed, open_, facts = scan(self.language, text, self.state, places)
        last = 0
        for at in cuts(self.language, text, places, len(self.stack)):
            if at - last >= STATEMENTS or self.head == "":
                self.parts.append(text[last:at])
                self._close()
                last = at
        self.parts.append(text[last:])
        stack = pushed(self.stack, closed, open_)
        self.stopped = stack is None
        self.stack = stack or ""

    def _close(self) -> None:
        text, self.parts = "".join(self.parts), []
        facts = scan("c", text, self.begun)[3] + _types("c", text) if self.language == "c" and self.grouped else ""
        self.facts, self.begun = self.facts + facts, "N"
        if self.head == "":
            self.head = text
            self.judge.pass_over(facts)
        else:
            self.judge.see(text)

    def ended(self) -> bool:
        """The end of the file: whether all of it, from a start at its head, is known to be valid."""
        self._close()
        return not (self.stopped or self.judge.bad or self.state not in ("N", "//") or self.stack or len(set(self.judge.exports)) < len(self.judge.exports) or self.judge.env is not None and self.judge.env.stack)


def holds(language: str, text: str) -> bool:
    """Whether a text of one chunk is valid: by its state map, its statements and their facts, else by the exact check."""
    walk = Walk(language)
    walk.feed(text)
    return walk.ended() or is_valid(language, text)


def chunked(text: str, size: int) -> list[str]:
    """Stretches of whole lines of about `size` characters."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at + size - 1) + 1 or len(text)
        out.append(text[at:end])
        at = end
    return out


def _own(files: DataFrame) -> DataFrame:
    return files.where(F.col("language").isin(*LANGUAGES) & (F.coalesce("file_source", F.lit("")) != "knowledge_base")).select(F.col("id").alias("file_id"), "repo_id", "language").dropDuplicates(["file_id"])


def broken(files: DataFrame, texts: DataFrame, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """(file_id): the files whose text isn't valid in their language."""
    sources = spread(texts.select("file_id", "content")).where("content is not null").join(_own(files).select("file_id", "language"), "file_id")

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(20_000)
        for b in batches:
            bad = [i for i, l, text in zip(b["file_id"], b["language"], b["content"]) if not holds(l, text)]
            yield pd.DataFrame({"file_id": pd.Series(bad, dtype="int64")})

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(20_000)
        for b in batches:
            bad = [i for i, l, text in zip(b["file_id"], b["language"], b["content"]) if not is_valid(l, text)]
            yield pd.DataFrame({"file_id": pd.Series(bad, dtype="int64")})

    def chop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, l, key, text in zip(b["file_id"], b["language"], b["key"], b["content"]):
                parts = chunked(text, chunk)
                for k in range(0, len(parts), 4096):
                    rows = range(k, min(k + 4096, len(parts)))
                    yield pd.DataFrame({"file_id": i, "language": l, "key": key, "grp": [r // group for r in rows], "chunk": rows, "last": [r == len(parts) - 1 for r in rows], "text": parts[k : k + 4096]})

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list]]:
        """The chunks of each group, which a partition holds in order; a repeated text counts once."""
        now, rows = None, []
        for b in batches:
            for r in b.itertuples(index=False):
                k = (r.file_id, r.key, r.grp)
                if k != now and rows:
                    yield now, rows
                    rows = []
                now = k
                if not rows or rows[-1].chunk != r.chunk:
                    rows.append(r)
        if rows:
            yield now, rows

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["file_id", "key", "grp", "language", "last", "state", "end", "closed", "open", "facts"]
        for k, rows in runs(batches):
            total = None
            for r in rows:
                own = state_map(r.language, r.text)
                total = compose(total, own) if total else own
            yield pd.DataFrame([(*k, rows[0].language, rows[-1].last, s, *x) for s, x in total.items()], columns=cols)

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        maps: dict[int, dict[str, Summary]] = {}
        for r in g.itertuples():
            maps.setdefault(r.grp, {})[r.state] = (r.end, r.closed, r.open, r.facts)
        language, total, out, fits = g["language"].iloc[0], None, [], True
        for k in sorted(maps):
            state, closed, open_, facts = total["N"] if total else ("N", "", "", "")
            fits = fits and not closed
            out.append((k, state, open_, facts))
            total = compose(total, maps[k]) if total else maps[k]
        state, closed, open_, facts = total["N"]
        fits = fits and state in ("N", "//") and not closed and not open_
        if fits and language == "c":
            judge = Judge("c", True, facts)
            fits = not (judge.bad or judge.env.stack)
        return pd.DataFrame([(g["file_id"].iloc[0], g["key"].iloc[0], *r, fits) for r in out], columns=["file_id", "key", "grp", "state", "stack", "facts", "fits"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of what: `bad` files, names they `export`, and `cut` statements, by place and part, with the facts before them."""
        sys.setrecursionlimit(20_000)
        cols = ["file_id", "key", "language", "what", "name", "grp", "part", "text", "facts"]
        for (i, key, k), rows in runs(batches):
            if not rows[0].fits:
                yield pd.DataFrame([(i, key, rows[0].language, "bad", None, k, 0, None, None)], columns=cols)
                continue
            first, language = k == 0, rows[0].language
            w = Walk(language, rows[0].state, rows[0].stack, rows[0].facts, first, True)
            for r in rows:
                w.feed(r.text)
            out = [(i, key, language, "export", x, k, 0, None, None) for x in w.judge.exports]
            tail = "".join(w.parts)
            if w.judge.bad or w.stopped:
                out.append((i, key, language, "bad", None, k, 0, None, None))
            elif w.head == "":  # one statement goes on through the whole group
                out.append((i, key, language, "cut", None, k, 0, tail, rows[0].facts))
            else:
                if w.head is not None:
                    out.append((i, key, language, "cut", None, k, 0, w.head, rows[0].facts))
                out.append((i, key, language, "cut", None, k, 1, tail, w.facts))
            yield pd.DataFrame(out, columns=cols)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(20_000)
        for b in batches:
            out = []
            for i, key, l, stretch, text, facts in zip(b["file_id"], b["key"], b["language"], b["stretch"], b["text"], b["facts"]):
                j = Judge(l, False, facts)
                j.see(text)
                out += [(i, key, "export", x) for x in j.exports] + [(i, key, "bad", None)] * j.bad
            yield pd.DataFrame(out, columns=["file_id", "key", "what", "name"])

    short = sources.where(F.length("content") <= chunk).mapInPandas(one, "file_id long")
    long_ = sources.where(F.length("content") > chunk).withColumn("key", F.xxhash64("content"))
    text_of = "file_id long, language string, key long, grp int, chunk int, last boolean, text string"
    order = ["file_id", "key", "grp", "chunk"]
    chunks = cut(long_.select("file_id", "language", "key", "content").mapInPandas(chop, text_of).repartition("file_id", "key", "grp").sortWithinPartitions(*order))
    maps = chunks.mapInPandas(summarise, "file_id long, key long, grp int, language string, last boolean, state string, end string, closed string, open string, facts string")
    starts = maps.groupBy("file_id", "key").applyInPandas(fold, "file_id long, key long, grp int, state string, stack string, facts string, fits boolean")
    placed = chunks.join(starts, ["file_id", "key", "grp"]).sortWithinPartitions(*order)
    walked = cut(placed.mapInPandas(walk, "file_id long, key long, language string, what string, name string, grp int, part int, text string, facts string"))
    # A statement goes from one cut to the next, over any number of groups: gaps and islands, without the texts.
    pieces = walked.where("what = 'cut'")
    at = Window.partitionBy("file_id", "key").orderBy("grp", "part")
    stretch = pieces.select("file_id", "key", "grp", "part").withColumn("stretch", F.sum("part").over(at))
    whole = pieces.join(stretch, ["file_id", "key", "grp", "part"]).groupBy("file_id", "key", "language", "stretch").agg(F.array_sort(F.collect_list(F.struct("grp", "part", "text", "facts"))).alias("all"))
    whole = whole.select("file_id", "key", "language", "stretch", F.array_join(F.col("all.text"), "").alias("text"), F.element_at("all", 1)["facts"].alias("facts"))
    seen = walked.where("what <> 'cut'").select("file_id", "key", "what", "name").unionByName(whole.mapInPandas(judged, "file_id long, key long, what string, name string"))
    counted = seen.groupBy("file_id", "key", "what", "name").agg(F.count("*").alias("n"))
    doubtful = counted.where("what = 'bad' or n > 1").select("file_id").distinct()
    again = long_.join(doubtful, "file_id", "left_semi").select("file_id", "language", "content").mapInPandas(exact, "file_id long")
    return short.unionByName(again).distinct()


def rates(files: DataFrame, texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo_id, language, files, broken, rate, reported): per repository and language, beside what the latest run reported."""
    own = _own(files)
    bad = broken(files, texts).withColumn("bad", F.lit(1))
    latest = runs.where("repo_id is not null and parse_errors is not null").groupBy("repo_id").agg(F.max_by("parse_errors", F.struct("run_at", "id")).alias("reported"))
    per = own.join(bad, "file_id", "left").groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("broken"))
    return per.join(latest, "repo_id", "left").select("repo_id", "language", "files", "broken", F.round(F.col("broken") / F.col("files"), 6).alias("rate"), "reported")
