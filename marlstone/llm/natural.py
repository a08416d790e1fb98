"""Natural language hidden in source files: prose in comments and string literals, its language, and its share of each file.

A worker lexes a whole file and takes the comments and string literals; lines of code divide them, and each run of other
lines is kept where it reads as prose. Runs are segmented by dynamic programming: per-word language scores less a penalty
for every change of language. In runs of several scripts each segment is judged by itself. Bytes of the segments are summed by
file and language before the shuffle.

Defined results: null and empty texts, null contents and null lines give no row; repeated files, texts and comments are
folded; language text and unknown languages have no comments or literals in their text. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import langid
from marlstone.llm.lexing import spans
from marlstone.session import spread

MIN_WORDS = 3
MIN_CJK = 6

_TAG = re.compile(r"^\W*(?:TODO|FIXME|HACK|XXX|NOTE|BUG|NB|WARNING|OPTIMIZE|REVIEW)\b(?:\([^)\n]*\))?\s*[:\-]?\s*", re.I)
# How directives to tools begin.
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:noqa|eslint|tslint|jshint|jslint|prettier-ignore|pylint|flake8|mypy|pyright|type:\s*ignore|fmt:|yapf|isort|ruff|black:|pragma|nosec|coverage|istanbul|c8 |v8 ignore|@ts-|ts-ignore|clang-format|nolint|cppcheck|"
    r"spdx-license|sourcemappingurl|# ?sourceurl|webpack|region\b|endregion\b|global\s|globals\s|jshint|vim:|-\*-|emacs|coding[:=]|!/|usr/bin|doctest:|stylelint|codespell|sonar|lint\b|@flow|@jsx|<reference)"
)
_SQL = re.compile(r"(?is)^\W*(?:SELECT\b.+\bFROM\b|INSERT\s+INTO\b|UPDATE\s+\S+\s+SET\b|DELETE\s+FROM\b|(?:CREATE|DROP|ALTER)\s+(?:TABLE|INDEX|VIEW)\b|WITH\s+\w+\s+AS\b)")
_CODE = re.compile(r"[;{]\s*$|^\s*[}\])]+|\w\(\s*\)|\w\([\w\s.,\"'\[\]]*\)\s*(?:[;{.:]|$)|[=!<>]=|\+=|-=|=>|->|::|&&|\|\||^\s*[\w.\[\]]+\s*=\s*\S|^\s*(?:return|if|for|while|else|elif|import|from|def|class|const|let|var|function|static|struct|throw|raise|yield|await|await|export|del|assert|try|except|catch|switch|case|break|continue)\b(?=.*[(){};=:]\s*$|\s+[\w.]+\s*;?\s*$)")
_CALL = re.compile(r"[A-Za-z_][\w.]*\([\w\s.,\"'\[\]]*\)")
_NOT_WORDS = re.compile(r"\S*(?:https?://|www\.)\S*|\S*@\w+\.\w\S*|\$\{[^}]*\}|\{[^{}\s]*\}|%[-+ #0]*\d*(?:\.\d+)?[a-zA-Z]|\b\S*[\w.-]+/[\w./-]+|\b[A-Za-z]\w*_\w*\b|\b\w*\d\w*\b|\b\w+(?:\.\w+)+\b|\b[a-z]+[A-Z]\w*\b|<[^<>\n]{1,60}>|&\w+;")


def prose_language(text: str | None) -> str | None:
    """The main language of a sentence or phrase, or None where the text is no prose."""
    parts = prose_segments(text)
    if not parts:
        return None
    sizes: dict[str, int] = {}
    for lang, n in parts:
        sizes[lang] = sizes.get(lang, 0) + n
    return max(sizes, key=lambda k: (sizes[k], k))


def _plain(words: list[tuple[str, int, int]]) -> list[str]:
    return [w for w, _, _ in words if w.islower() or w[0].isupper() and w[1:].islower() or w in ("I", "A") or len(w) == 1 or w.isupper() and len(words) > 4]


def _enough(plain: list[str]) -> bool:
    return len(plain) >= MIN_WORDS and len([w for w in plain if len(w) > 1]) >= MIN_WORDS


def _cjk(words: list[tuple[str, int, int]]) -> int:
    return sum(w[0] > "⺀" for w, _, _ in words)


def _prose_line(line: str) -> str | None:
    """The line, without the calls that a sentence mentions; None where it is code. Sentences of Han or kana aren't."""
    if not _CODE.search(line) or _cjk(langid.words_of(line)) >= max(MIN_CJK, 0.4 * len(re.sub(r"\s", "", line))):
        return line
    said = _CALL.sub(" ¤ ", line)
    if said == line or _CODE.search(said):
        return None
    rest = _NOT_WORDS.sub(" ¤ ", said)
    words = langid.words_of(rest)
    return said if _enough(_plain(words)) and _reads(rest, langid.main_language(rest) or "", len(words)) else None


def prose_segments(text: str | None) -> list[tuple[str, int]]:
    """(language, bytes) of the segments of a comment or literal in order, none where it is no prose.

    Lines of code divide it; each run of other lines is judged by itself.
    """
    if not text or len(text) < 6 or _DIRECTIVE.match(text):
        return []
    s = _TAG.sub("", text.replace("\\n", "\n").replace("\\t", " ").replace('\\"', '"').replace("\\'", "'"))
    s = re.sub(r"`[^`\n]*`", " ¤ ", s)
    if _SQL.match(s) or _DIRECTIVE.match(s) or " | " in s and re.search(r"\bv?\d+\.\d", s):
        return []
    out, run = [], []
    for line in [*map(_prose_line, s.strip().split("\n")), None]:
        if line is not None:
            run.append(line)
        elif run:
            out += _run_segments("\n".join(run))
            run = []
    return out


def _run_segments(s: str) -> list[tuple[str, int]]:
    """The segments of lines without code."""
    rest = _NOT_WORDS.sub(" ¤ ", s)
    words = langid.words_of(rest)
    cjk = _cjk(words)
    mixed = cjk >= MIN_CJK and cjk < 0.4 * len(re.sub(r"\s", "", s))
    if cjk < MIN_CJK and not _worded(rest, words):
        return []
    segs = langid.segments(rest)
    if mixed:  # neither script decides for the other
        segs = [x for x in segs if _stands(rest[x[1] : x[2]], x[0])]
    total = sum(len(rest[a:b].encode()) for _, a, b in segs)
    main = max({x for x, _, _ in segs}, key=lambda k: sum(len(rest[a:b]) for x, a, b in segs if x == k)) if segs else None
    if main is None or total == 0:
        return []
    if cjk < MIN_CJK and main != "ru" and not _reads(rest, main, len(words)):
        return []
    return [(x, len(rest[a:b].encode())) for x, a, b in segs]


def _worded(rest: str, words: list[tuple[str, int, int]]) -> bool:
    """Enough words in their usual writing, few other marks."""
    plain = _plain(words)
    return _enough(plain) and len(plain) >= 0.6 * len(re.findall(r"[^\W\d_]+|[^\w\s.,;:!?'’\"()\-]+|\d+", rest))


def _stands(part: str, lang: str) -> bool:
    """Whether a segment of a text of several scripts is prose by itself."""
    words = langid.words_of(part)
    if lang in ("zh", "ja"):
        return _cjk(words) >= max(MIN_CJK, 0.4 * len(re.sub(r"\s", "", part)))
    return _worded(part, words) and (lang == "ru" or _reads(part, lang, len(words)))


def _reads(text: str, lang: str, n: int) -> bool:
    """A phrase has a function word, and no list of names has many."""
    return langid.evidence(text, lang) >= (1 if n <= 12 else 2)


def found_spans(files: DataFrame, texts: DataFrame, comments: DataFrame) -> DataFrame:
    """(file_id, line_no, lang, bytes, seen, part): the segments of prose; `seen` tells the spans of one line apart, `part` their segments."""
    lang = files.select(F.col("id").alias("file_id"), "language").where("language is not null").dropDuplicates(["file_id"])
    own = spread(texts.select("file_id", "content")).where(F.length("content") > 0).join(lang, "file_id")

    def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, l, text in zip(b["file_id"], b["language"], b["content"]):
                line, at = 1, 0
                for sp in spans(l, text):
                    line, at = line + text.count("\n", at, sp.start), sp.start
                    if sp.kind in ("doc", "docstring"):
                        continue
                    for part, (k, n) in enumerate(prose_segments(sp.body)):
                        out.append((i, line, k, n, sp.body if sp.kind != "string" else f"'{sp.body}", part))
            yield pd.DataFrame(out, columns=["file_id", "line_no", "lang", "bytes", "seen", "part"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, line, k, n, c.strip(), part) for i, line, c in zip(b["file_id"], b["line_no"], b["content"]) for part, (k, n) in enumerate(prose_segments(c))]
            yield pd.DataFrame(out, columns=["file_id", "line_no", "lang", "bytes", "seen", "part"])

    schema = "file_id long, line_no long, lang string, bytes long, seen string, part int"
    lexed = own.select("file_id", "language", "content").mapInPandas(lex, schema)
    known = comments.select("file_id", F.col("line").cast("long").alias("line_no"), "content").where("file_id is not null and line is not null and content is not null").distinct().mapInPandas(judge, schema)
    # A comment comes from its text and from the table: one of the two counts.
    return lexed.unionByName(known).withColumn("seen", F.xxhash64("seen")).distinct()


def lines(files: DataFrame, texts: DataFrame, comments: DataFrame) -> DataFrame:
    """(file_id, line_no, lang): the language of each comment or literal of prose, at the line on which it starts."""
    per = found_spans(files, texts, comments).groupBy("file_id", "line_no", "seen", "lang").agg(F.sum("bytes").alias("n"))
    return per.groupBy("file_id", "line_no", "seen").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang")).select("file_id", "line_no", "lang").distinct()


def shares(files: DataFrame, texts: DataFrame, comments: DataFrame) -> DataFrame:
    """(file_id, lang, bytes, share): bytes of prose by file and language, and their share of the file's bytes."""
    sizes = texts.select("file_id", F.octet_length("content").alias("size")).where("size > 0").dropDuplicates(["file_id"])
    per = found_spans(files, texts, comments).groupBy("file_id", "lang").agg(F.sum("bytes").alias("bytes"))
    return per.join(sizes, "file_id").select("file_id", "lang", "bytes", F.round(F.col("bytes") / F.col("size"), 6).alias("share"))
