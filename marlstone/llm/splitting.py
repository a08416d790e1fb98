"""Splitting oversized texts at natural boundaries, by ranges, so that no worker needs a whole giant text.

A text is cut into ranges of `range_chars` characters, each with a halo of one character before it. A worker finds, in its
range, where tokens start (a place whose class differs from that before it, so that counts of ranges add up), the
paragraph parts, and the first boundary of each kind. One summary row per range is stitched per text: a running sum gives
every range its token and paragraph offsets, and an open paragraph is joined across ranges. Where a piece ends depends on
the piece before it, so pieces are cut by one worker that the ranges of a text pass in order, with the open tokens kept.

A text of one range, nearly all of them, takes the same functions in one worker, without the stitching shuffle.

Defined results: null, empty and blank texts have no paragraph and no piece; a text under the limit is one piece; a text
without any boundary is cut between tokens, a single token is never cut; repeated ids are kept apart only by equal rows
giving equal results, so repeated rows are folded. Other columns aren't read.
"""

from __future__ import annotations

import io
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import TOKEN
from marlstone.session import spread

LIMIT = 256
OVERLAP = 32
RANGE_CHARS = 1 << 20

PARAGRAPH = re.compile(r"\r?\n(?:[ \t]*\r?\n)+")
SENTENCE = re.compile(r"(?<=[.!?:;])[\"')\]]*\s+|(?<=[。！？；])|\n")


def ranges(df: DataFrame, id_col: str, text_col: str, size: int = RANGE_CHARS) -> DataFrame:
    """(id, key, rng, of, at, text): the ranges of each text, by id and hash; `at` is where the range starts, its text has one character more before."""
    n = F.greatest(F.ceil(F.length("text") / size), F.lit(1)).cast("int")
    own = spread(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))).where(F.length("text") > 0)
    rows = own.select("id", "key", "text", n.alias("of"), F.explode(F.sequence(F.lit(0), n - 1)).alias("rng"))
    at = (F.col("rng") * size).cast("long")
    part = F.when(F.col("of") == 1, F.col("text")).otherwise(F.substring("text", F.greatest(at, F.lit(1)).cast("int"), F.when(at == 0, size).otherwise(size + 1)))
    return rows.select("id", "key", "rng", "of", at.alias("at"), part.alias("text"))


def _tokens(text: str, before: str = "") -> int:
    """Tokens that start in the text, given the character before it."""
    n = len(TOKEN.findall(text))
    if n and before and not before.isspace() and not text[0].isspace():
        n -= (before.isalnum() or before == "_") == (text[0].isalnum() or text[0] == "_")
    return n


def _fragment(line: str) -> str:
    """What a part of a line is for the test that the line is blank: '' nothing, B blanks, R blanks and a final \\r, N other."""
    if not line:
        return ""
    if not line.strip(" \t"):
        return "B"
    return "R" if line[-1] == "\r" and not line[:-1].strip(" \t") else "N"


def _joined(a: str, b: str) -> str:
    return b if not a else a if not b else "N" if a in "RN" or b == "N" else b


def line_runs(text: str, before: str) -> tuple[list[tuple[int, bool]], str, str, int, int]:
    """Paragraph parts of a range that is not a whole text: see `summary`."""
    lines = text.split("\n")
    head, tail = _fragment(lines[0]), _fragment(lines[-1])
    inner: list[tuple[int, bool]] = []
    for line in lines[1:-1]:
        inner.append((_tokens(line), _fragment(line) in ("", "B", "R")))
    return inner, head, tail, _tokens(lines[0], before), _tokens(lines[-1]) if len(lines) > 1 else 0


def summary(text: str, before: str, limit: int) -> dict:
    """One range: tokens at its head up to the first newline, runs inside, tokens at its tail.

    Runs of lines that aren't blank are folded; `first` and `last` touch the head and the tail line, those between are
    whole paragraphs, of which only the number and those above the limit are kept.
    """
    inner, head, tail, n_head, n_tail = line_runs(text, before)
    runs, open_ = [], False
    for n, blank in inner:
        if blank:
            open_ = False
        elif open_:
            runs[-1] += n
        else:
            runs.append(n)
            open_ = True
    starts_open = bool(inner) and not inner[0][1]
    first = runs.pop(0) if starts_open else 0
    whole_line = starts_open and not any(b for _, b in inner)
    ends_open = open_ and not whole_line
    last = runs.pop() if ends_open else 0
    real = [n for n in runs if n]
    return {
        "newline": "\n" in text, "head": head, "tail": tail, "n_head": n_head, "n_tail": n_tail, "first": first, "last": last,
        "whole": whole_line, "blank_inside": any(b for _, b in inner), "inside": len(real), "large": [(i, n) for i, n in enumerate(real) if n > limit],
    }


def stitch(parts: list[dict]) -> list[tuple[int, int]]:
    """(number, tokens) of the paragraphs above the limit kept in order; `parts` are the summaries of one text's ranges.

    State: the class and tokens of the open line, and the tokens of the open paragraph before that line.
    """
    out: list[tuple[int, int]] = []
    done, para, line, n_line = 0, 0, "", 0

    def close() -> None:
        nonlocal done, para
        if para:
            done += 1
            out.append((done, para))
        para = 0

    def end_line() -> None:
        nonlocal para, line, n_line
        if line in ("", "B", "R"):
            close()
        else:
            para += n_line
        line, n_line = "", 0

    for p in parts:
        line, n_line = _joined(line, p["head"]), n_line + p["n_head"]
        if not p["newline"]:
            continue
        end_line()
        para += p["first"]
        if p["blank_inside"]:
            close()
            out += [(done + 1 + i, n) for i, n in p["large"]]
            done += p["inside"]
            para = p["last"]
        line, n_line = p["tail"], p["n_tail"]
    end_line()
    close()
    return out


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(id, para_no, tokens) of the paragraphs with more than `limit` tokens, distinct."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = ranges(df, id_col, text_col, range_chars)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, nos, ns = [], [], []
            for i, text in zip(b["id"], b["text"]):
                if len(text) <= limit:  # a token has a character at least
                    continue
                for no, n in stitch([summary(text, "", limit)]):
                    if n > limit:
                        ids.append(i), nos.append(no), ns.append(n)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype), "para_no": pd.Series(nos, dtype="int64"), "tokens": pd.Series(ns, dtype="int64")})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, r, at, text in zip(b["id"], b["rng"], b["at"], b["text"]):
                before, own = ("", text) if at == 0 else (text[0], text[1:])
                s = summary(own, before, limit)
                out.append({"id": i, "rng": r} | s | {"large_i": [x for x, _ in s["large"]], "large_n": [x for _, x in s["large"]]})
            cols = ["id", "rng", "newline", "head", "tail", "n_head", "n_tail", "first", "last", "blank_inside", "inside", "large_i", "large_n"]
            yield pd.DataFrame(out, columns=[*cols])

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rng").drop_duplicates("rng")
        ps = [r | {"large": list(zip(r["large_i"], r["large_n"]))} for r in g.to_dict("records")]
        found = [(no, n) for no, n in stitch(ps) if n > limit]
        return pd.DataFrame({"id": [g["id"].iloc[0]] * len(found), "para_no": [no for no, _ in found], "tokens": [n for _, n in found]})

    schema = f"id {kind}, para_no long, tokens long"
    short = rows.where(F.col("of") == 1).select("id", "text").mapInPandas(whole, schema)
    table = f"id {kind}, rng int, newline boolean, head string, tail string, n_head long, n_tail long, first long, last long, blank_inside boolean, inside long, large_i array<int>, large_n array<long>"
    long_ = rows.where(F.col("of") > 1).repartition("id", "rng").select("id", "rng", "at", "text").mapInPandas(parts, table).groupBy("id").applyInPandas(joined, schema)
    return short.unionByName(long_).distinct()


class _Cutter:
    """Cuts a text that comes in parts, in order. It holds the part, and the tokens that the next piece may need."""

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap
        self.tail, self.place = "", 0  # from the last token on, which may go on in the next part
        self.spans: list[tuple[int, int]] = []
        self.rank: list[int] = []  # of the boundary before each token: 3 paragraph, 2 line or sentence, 0 none
        self.at = self.new = 0  # first token of the piece, and its first token that no piece had before

    def feed(self, part: str, last: bool) -> list[tuple[int, int, int, int, str]]:
        """(start, end, tokens, shared with the piece before, boundary at the end) of the pieces that are certain now."""
        text = self.tail + part
        found = [m.span() for m in TOKEN.finditer(text)]
        if not found:  # blank so far
            self.tail = text
            return []
        starts = [s for s, _ in found]
        rank = [0] * (len(found) + 1)
        for m in SENTENCE.finditer(text):
            rank[bisect_left(starts, m.end())] = 2
        for m in PARAGRAPH.finditer(text):
            rank[bisect_left(starts, m.end())] = 3
        if self.spans:
            self.spans.pop()
            rank[0] = self.rank.pop()
        self.spans += [(self.place + s, self.place + e) for s, e in found]
        self.rank += rank[:-1]
        self.tail, self.place = text[starts[-1] :], self.place + starts[-1]
        return self._cut(last)

    def _cut(self, last: bool) -> list[tuple[int, int, int, int, str]]:
        spans, rank, n = self.spans, self.rank + [4 if last else 0], len(self.spans)
        at, new, out = self.at, self.new, []
        while new < n and (last or at + self.limit < n):
            top = min(n, at + self.limit)
            best = top
            for want in (4, 3, 2):
                ok = [i for i in range(top, new, -1) if rank[i] >= want]
                if ok and (want == 4 or ok[0] - at > self.limit // 4):
                    best = ok[0]
                    break
            out.append((spans[at][0], spans[best - 1][1], best - at, new - at, {4: "end", 3: "paragraph", 2: "sentence"}.get(rank[best], "token")))
            if best == n:
                break
            new, at = best, max(at + 1, best - self.overlap)
            for i in range(at, new):  # start the overlap at a sentence where one starts inside it
                if rank[i] >= 2:
                    at = i
                    break
        del self.spans[:at], self.rank[:at]
        self.at, self.new = 0, new - at
        return out


def split(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(id, piece_no, start, end, tokens, shared, boundary): pieces of at most `limit` tokens, by 0-based character offsets.

    Every token is new in exactly one piece; `shared` of the piece's first tokens belong to the piece before too, `overlap` at most.
    The ranges of a text pass one worker in order, so that their size doesn't change the pieces and none holds the whole text.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    kind = df.schema[id_col].dataType.simpleString()
    rows = ranges(df, id_col, text_col, range_chars)

    def cutting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cutter = None, _Cutter(limit, overlap)
        for b in batches:
            out = []
            for i, key, r, of, at, t in zip(b["id"], b["key"], b["rng"], b["of"], b["at"], b["text"]):
                own = None if pd.isna(i) else i, key
                if (own, r) == now:
                    continue
                if r == 0:
                    cutter = _Cutter(limit, overlap)
                now = own, r
                out += [(i, *x) for x in cutter.feed(t if at == 0 else t[1:], r == of - 1)]
            yield pd.DataFrame(out, columns=["id", "start", "end", "tokens", "shared", "boundary"])

    cols = ["id", "key", "rng", "of", "at", "text"]
    one = rows.where(F.col("of") == 1).select(*cols)
    many = rows.where(F.col("of") > 1).select(*cols).repartition("id", "key").sortWithinPartitions("id", "key", "rng")
    schema = f"id {kind}, start long, end long, tokens long, shared long, boundary string"
    done = one.mapInPandas(cutting, schema).unionByName(many.mapInPandas(cutting, schema)).distinct()
    w = Window.partitionBy("id").orderBy("start", "end")
    return done.select("id", (F.row_number().over(w) - 1).cast("long").alias("piece_no"), "start", "end", "tokens", "shared", "boundary")


def file_ranges(spark, paths: list[str], range_bytes: int = 64 << 20) -> DataFrame:
    """(path, rng, at, text): ranges of giant UTF-8 files, by address in any shared file system, each worker reading only its bytes.

    A range starts after the first newline at or behind its offset and ends with the line that its last byte is in.
    """
    from pyarrow import fs

    def opened(path: str):
        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return system, at

    jobs = []
    for p in paths:
        system, at = opened(p)
        jobs += [(p, k, k * range_bytes) for k in range(max(1, -(-(system.get_file_info(at).size or 0) // range_bytes)))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, k, at in zip(b["path"], b["rng"], b["at"]):
                system, name = opened(path)
                with io.BufferedReader(system.open_input_file(name), 1 << 20) as f:
                    if at:
                        f.seek(at - 1)
                        f.readline()
                    begin = f.tell()
                    data = f.read(max(0, at + range_bytes - begin))
                    if data and not data.endswith(b"\n"):
                        data += f.readline()
                if data:
                    yield pd.DataFrame({"path": [path], "rng": [k], "at": [begin], "text": [data.decode("utf-8", "replace")]})

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("rng", T.IntegerType()), T.StructField("at", T.LongType())])
    df = spark.createDataFrame(jobs, schema).repartition(max(1, len(jobs)))
    return df.mapInPandas(read, "path string, rng int, at long, text string")
