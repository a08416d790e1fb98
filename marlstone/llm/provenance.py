"""Generated, minified, vendored and data files among sources.

1. Attribute files (`.gitattributes`) declare paths as generated or vendored; the last matching line of the deepest
   directory wins. Library rows are declared too.
2. From declared files, and from files that count upwards line by line as only tools write, equivalents are mined: comment
   lines whose wording recurs in them over several repositories, and the package names below which vendored copies lie.
   They are applied to repositories that declare nothing. Names of folders alone prove nothing.
3. Texts decide the rest: lines far too long, tables of literals without code, and near copies (shingles of five words,
   overlap of 0.8 or more) that other repositories or libraries hold too.

Near copies: equal word sequences are one class first; classes that share one of their seldom shingles are compared, which
finds every pair over the bound (see `near_copies`). Texts of fewer than MIN_SHINGLES count where a library has the same words.

Defined results: null and empty texts are judged by path and source alone; knowledge_base rows are never found; repeated
rows are folded, and a file with several texts is found by any; null paths match no pattern. Other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.lexing import spans
from marlstone.session import cut, spread

SHINGLE = 5
SIMILARITY = 0.8
LEAST_SIZE = 0.6
MIN_SHINGLES = 30
LONG_LINE = 250

# How tools announce their output.
BANNER = re.compile(
    r"(?i)@generated\b(?! with the help)|\bcode generated by\b|\b(?:auto-?generated|automatically (?:generated|built|created|produced)) (?:by|from|on|file|code|with|using|-|—)|\bgenerated (?:by|from) \S+.*\b(?:do not|don't|not be) (?:edit|modify|change)|"
    r"\bdo not (?:edit|modify|change)\b.*\b(?:by hand|manually|directly|generated|this file)\b|\bDO NOT (?:EDIT|MODIFY)\b|\b(?:this file|the contents?) (?:was|were|is|are)\b.*\b(?:produced|generated|written|created) (?:from|by) |\bany changes? (?:made )?(?:here )?will be (?:lost|overwritten)\b|"
    r"\bregenerate (?:this|it) with\b|\bedit the template\b|\bplease leave (?:them|it) alone\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht von hand (?:bearbeiten|ändern)\b|\bgénéré automatiquement\b|\bne pas modifier (?:à la main|manuellement)\b|\bgenerado automáticamente\b|\bno (?:editar|modificar) (?:a mano|manualmente)\b|"
    r"\bgerado automaticamente\b|\bnão (?:edite|editar|modificar) (?:à mão|manualmente)\b|\bwygenerowan[eoya]+ automatycznie\b|\bnie (?:edytować|edytuj|zmieniać) ręcznie\b|сгенерирован[оа]? автоматически|не (?:редактировать|изменять) вручную|自动生成|请勿(?:手动)?(?:编辑|修改)|自動生成|手動で(?:編集|変更)しないで"
)
_STUB = re.compile(r"(?i)\b(?:method|function|constructor|class) stub\b")
_VENDOR_DIR = r"(?:_?vendor(?:ed)?|node_modules|third[-_]?party|3rd[-_]?party|deps|extern(?:al)?s?|bower_components|site-packages|contrib|Pods)"
_LITERAL_LINE = re.compile(r"^\s*[\[({]*\s*(?:(?:[rbufL]{0,2}\"[^\"]*\"|[rbuf]{0,2}'[^']*'|[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfFn]*|[\[\](){},:]|\s)+)[\])},;]*\s*$")

_LITERAL_START = re.compile(r"\s*(?:[\[\](){},:\"'\d+-]|[rbufL]{1,2}[\"'])")

# --- attribute files ---------------------------------------------------------------------------------------------------

def glob_regex(pattern: str) -> str:
    """A regular expression for an attribute pattern, to match against a path below the attribute file's directory."""
    anchored = "/" in pattern.rstrip("/")
    p, out, i = pattern.strip("/"), "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (k := p.find("]", i + 2)) > 0:
            body = p[i + 1 : k]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", k + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("" if anchored else r"(?:.*/)?") + out + r"\Z"


def parse_attributes(text: str) -> list[tuple[str, str, bool | None]]:
    """(pattern, attribute, value) lines in order; the value is None where the attribute is unset again with `!`."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        m = re.match(r'"((?:\\.|[^"\\])*)"\s*(.*)|(\S+)\s*(.*)', line)
        pattern, rest = (m[1], m[2]) if m[1] is not None else (m[3], m[4])
        for a in rest.split():
            name, _, value = a.lstrip("-!").partition("=")
            if name in ("linguist-generated", "linguist-vendored"):
                out.append((pattern, name, None if a[0] == "!" else a[0] != "-" and value.lower() not in ("false", "0")))
    return out


def resolve(path: str, rules: list[tuple[str, str, str, bool | None]]) -> dict[str, bool]:
    """The attributes of a path; `rules` are (directory, pattern, attribute, value): deeper directories win, then later lines."""
    found: dict[str, bool] = {}
    for d, pattern, name, value in sorted(rules, key=lambda r: r[0].count("/") + bool(r[0])):
        if (not d or path.startswith(d + "/")) and re.match(glob_regex(pattern), path[len(d) + 1 if d else 0 :]):
            if value is None:
                found.pop(name, None)
            else:
                found[name] = value
    return found


def declared(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id): files that their repository's attribute files mark as generated or vendored."""
    rows = files.select(F.col("id").alias("file_id"), "repo_id", "path").where("path is not null and repo_id is not null").distinct()
    own = rows.where(F.col("path").rlike(r"(^|/)\.gitattributes$")).join(texts.select("file_id", "content"), "file_id")
    rules = own.groupBy("repo_id").agg(F.collect_set(F.struct(F.regexp_replace("path", r"/?\.gitattributes$", "").alias("dir"), "content")).alias("rules"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, list] = {}
        for b in batches:
            out = []
            for i, path, rs in zip(b["file_id"], b["path"], b["rules"]):
                key = tuple(sorted((r["dir"], r["content"] or "") for r in rs))
                if key not in seen:
                    seen[key] = [(d, *x) for d, text in key for x in parse_attributes(text)]
                if any(resolve(path, seen[key]).values()):
                    out.append(i)
            yield pd.DataFrame({"file_id": pd.Series(out, dtype="int64")})

    return rows.join(rules, "repo_id").select("file_id", "path", "rules").mapInPandas(judge, "file_id long").distinct()


# --- evidence in the text ----------------------------------------------------------------------------------------------

_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|\d+")


def counts_upwards(lines: list[str]) -> bool:
    """Most lines come from a few line templates in which one number goes up by one from use to use."""
    uses: dict[str, list[list[int]]] = {}
    for x in lines:
        nums = _NUMBER.findall(x)
        own = _NUMBER.sub("#", x.strip()) if nums else x.strip()
        # The last digits tell a step of one, however long a number is.
        uses.setdefault(own, []).append([int(n[2:][-15:], 16) if n[:2] in ("0x", "0X") else int(n[-18:]) for n in nums])
    good = 0
    for rows in uses.values():
        if len(rows) >= 6 and rows[0]:
            for k in range(len(rows[0])):
                steps = [b[k] - a[k] for a, b in zip(rows, rows[1:])]
                if sum(s == 1 for s in steps) >= 0.8 * len(steps):
                    good += len(rows)
                    break
    if good >= 0.5 * len(lines) and good >= 6:
        return True
    # Whole functions repeated: lines without a number count where their template comes as often as a counting one.
    often = Counter({t: len(r) for t, r in uses.items()})
    counting = {len(r) for r in uses.values() if len(r) >= 6 and r[0] and any(sum(b[k] - a[k] == 1 for a, b in zip(r, r[1:])) >= 0.8 * (len(r) - 1) for k in range(len(r[0])))}
    return bool(counting) and sum(n for n in often.values() if any(abs(n - c) <= max(1, c // 10) or n % c == 0 for c in counting)) >= 0.7 * len(lines) and good >= 0.2 * len(lines)


def is_minified(text: str) -> bool:
    long = sum(len(x) for x in text.split("\n") if len(x) > LONG_LINE)
    if long < 0.4 * len(text) or len(text) < LONG_LINE:
        return False
    code = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "", text)
    return sum(c.isspace() for c in text) < 0.13 * len(text) or len(re.findall(r"[;{}(),=]", code)) > 0.12 * len(code)


def is_blob(lines: list[str]) -> bool:
    """A table of literals that is most of the file."""
    own = [x for x in lines if _LITERAL_START.match(x) and len(x.strip()) > 4 and _LITERAL_LINE.match(x)]
    size = sum(len(x.strip()) for x in lines)
    return len(own) >= 15 and sum(len(x.strip()) for x in own) >= 0.5 * size or size > 0 and any(len(x) > LONG_LINE and _LITERAL_LINE.match(re.sub(r"^[\w\s*\[\].]*=\s*", "", x)) for x in lines) and sum(len(x) for x in lines if len(x) > LONG_LINE) > 0.6 * size


def line_template(line: str) -> str:
    """A comment line with names of files and tools, numbers and identifiers masked."""
    t = re.sub(r"\S*\d\S*|\b[\w-]+(?:[./][\w-]+)+\b|\b\w+_\w+\b", "§", line.strip())
    return re.sub(r"(?i)\b(by|the|with|from|aus|von|par|por|przez)( the)? \w+(?= (?:step|command|tool|from|aus)\b|[.,;]| - |$)", r"\1\2 §", t)


class _WordIds(dict):
    """Numbers of words by their hash, remembered for the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        n = self[word] = zlib.crc32(word.encode()) * 0x9E3779B97F4A7C15 % (1 << 64) | 1
        return n


_WORD_IDS = _WordIds()


def _hashes(text: str) -> tuple[int, np.ndarray]:
    words = re.findall(r"\w+", text.lower())
    if not words:
        return 0, np.zeros(0, np.uint64)
    ids = np.fromiter(map(_WORD_IDS.__getitem__, words), np.uint64, len(words))
    m = max(1, len(ids) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(min(SHINGLE, len(ids))):
            h = (h ^ ids[k : k + m]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        whole = int((h * np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64))
    return whole, np.unique(h)


_DIRECTIVES = ("#define", "#include", "#if", "#e", "#pragma", "#undef")
_CREDIT = re.compile(r"(?i)copyright|\blicen[cs]e|\bupstream \w+ at\b|\b(?:copied|imported|taken|vendored|bundled) from\b")


def features(files: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per file with text: the marks found in it, masked comment lines, word class and shingles."""
    rows = files.select(F.col("id").alias("file_id"), "repo_id", "path", "language", "file_source").where("file_source is null or file_source <> 'knowledge_base'").dropDuplicates(["file_id"])
    own = spread(texts.select("file_id", "content")).where(F.length("content") > 0).join(rows, "file_id")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["file_id", "repo_id", "path", "library", "upwards", "banner", "minified", "blob", "lines", "credits", "cls", "shingles"]
        for b in batches:
            out = []
            for i, repo, path, lang, src, text in zip(b["file_id"], b["repo_id"], b["path"], b["language"], b["file_source"], b["content"]):
                text = text.replace("\r\n", "\n")
                notes = [x for sp in spans(lang, text) if sp.kind in ("line", "block", "doc") for x in sp.body.split("\n") if len(x.split()) >= 3]
                code = [x for x in text.split("\n") if (y := x.lstrip()) and not (y.startswith(("//", "/*", "*")) or y[0] == "#" and not y.startswith(_DIRECTIVES))]
                banner = any(BANNER.search(x) and not _STUB.search(x) for x in notes)
                credits = sorted({w.lower() for x in notes if _CREDIT.search(x) for w in re.findall(r"[A-Za-z][\w-]+", x)})
                cls, h = _hashes(text)
                big = len(h) >= MIN_SHINGLES
                out.append((i, repo, path, src == "library", counts_upwards(code), banner, is_minified(text), is_blob(code), sorted({line_template(x) for x in notes}), credits, np.uint64(cls).astype(np.int64).item(), h.view(np.int64).tolist() if big else []))
            yield pd.DataFrame(out, columns=cols)

    return own.select("file_id", "repo_id", "path", "language", "file_source", "content").mapInPandas(
        look, "file_id long, repo_id long, path string, library boolean, upwards boolean, banner boolean, minified boolean, blob boolean, lines array<string>, credits array<string>, cls long, shingles array<long>"
    )


# --- mined equivalents -------------------------------------------------------------------------------------------------

def mined_lines(marks: DataFrame, min_files: int = 3, min_repos: int = 2, min_share: float = 0.3) -> DataFrame:
    """(line): masked comment lines that recur in declared or counting files of several repositories, and seldom elsewhere."""
    one = marks.select("repo_id", F.col("known").cast("int").alias("known"), F.explode("lines").alias("line"))
    per = one.groupBy("line").agg(F.count("*").alias("n"), F.sum("known").alias("k"), F.min(F.when(F.col("known") == 1, F.col("repo_id"))).alias("lo"), F.max(F.when(F.col("known") == 1, F.col("repo_id"))).alias("hi"))
    return per.where((F.col("k") >= min_files) & (F.col("k") >= min_share * F.col("n")) & ((F.col("lo") != F.col("hi")) if min_repos > 1 else F.lit(True))).select("line")


def packages(files: DataFrame) -> DataFrame:
    """(package): the first folder of library rows."""
    return files.where("file_source = 'library' and path like '%/%'").select(F.lower(F.split_part("path", F.lit("/"), F.lit(1))).alias("package")).where("length(package) > 2").distinct()


# --- near copies -------------------------------------------------------------------------------------------------------

def near_copies(classes: DataFrame, block: int = 2048) -> DataFrame:
    """(one, two): all links between word classes with an overlap of SIMILARITY or more, from (cls, shingles).

    Exact, by prefixes: with shingles in one order, seldom ones first, two classes that share t shingles share one among the
    first n - t + 1 of each. t is SIMILARITY of the smaller class, which has LEAST_SIZE of the larger one at least. A shingle
    of one class alone can't meet another: such are only counted. Shingles of many classes are met in blocks.
    """
    least_shared = lambda n: F.ceil(SIMILARITY * n - 1e-6)
    base = classes.where(F.size("shingles") > 0).select("cls", "shingles")
    each = base.select("cls", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    order = F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("order")
    shared = each.join(often, "shingle").groupBy("cls", "size").agg(order)
    alone = F.col("size") - F.size("order")
    reach = lambda t: F.greatest(F.col("size") - t + 1 - alone, F.lit(0)).cast("int")
    prefixes = cut(
        shared.withColumns({"short": reach(least_shared(F.col("size"))), "long": reach(least_shared(F.ceil(LEAST_SIZE * F.col("size") - 1e-6)))})
        .select("cls", "size", "short", F.posexplode(F.slice("order", F.lit(1), F.col("long"))).alias("at", "x"))
        .select("cls", "size", (F.col("at") < F.col("short")).alias("short"), "x.shingle", F.ceil(F.col("x.n") / block).cast("int").alias("blocks"))
    )
    one = prefixes.where("short").select("shingle", F.col("cls").alias("one"), F.col("size").alias("size1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    two = prefixes.select("shingle", F.col("cls").alias("two"), F.col("size").alias("size2"), F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"))
    smaller = (F.col("size1") < F.col("size2")) | (F.col("size1") == F.col("size2")) & (F.col("one") < F.col("two"))
    pairs = cut(one.join(two, ["shingle", "block"]).where(smaller & (F.col("size1") >= LEAST_SIZE * F.col("size2"))).select("one", "two").distinct())
    a = base.select(F.col("cls").alias("one"), F.col("shingles").alias("own"))
    b = base.select(F.col("cls").alias("two"), F.col("shingles").alias("other"))
    return pairs.join(a, "one").join(b, "two").where(F.size(F.array_intersect("own", "other")) >= SIMILARITY * F.size("own")).select("one", "two")


def third_party_classes(marks: DataFrame) -> DataFrame:
    """(cls): word classes that a library or several repositories hold, or near copies of such."""
    per = marks.where(F.size("shingles") > 0).groupBy("cls").agg(F.min("repo_id").alias("lo"), F.max("repo_id").alias("hi"), F.max("library").alias("library"), F.first("shingles").alias("shingles"))
    classes = cut(per)
    links = cut(near_copies(classes))
    both = links.unionByName(links.select(F.col("two").alias("one"), F.col("one").alias("two")))
    info = classes.select("cls", "lo", "hi", "library")
    joined = both.join(info.select(F.col("cls").alias("one"), F.col("lo").alias("lo1")), "one").join(info.select(F.col("cls").alias("two"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "two")
    found = cut(info.where("library or lo <> hi").select("cls").unionByName(joined.where("lo1 <> lo2 or lo1 <> hi2").select(F.col("one").alias("cls"))).distinct())
    while True:  # along links to near copies of near copies
        more = cut(both.join(found, both["one"] == found["cls"]).select(F.col("two").alias("cls")).distinct().join(found, "cls", "left_anti"))
        if more.isEmpty():
            return found
        found = cut(found.unionByName(more))


def not_hand_written(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, reasons): every file that was generated, minified, stored as data, or copied from third parties."""
    own = files.where("file_source is null or file_source <> 'knowledge_base'").select(F.col("id").alias("file_id"), "path", "file_source").dropDuplicates(["file_id"])
    said = cut(declared(files, texts).withColumn("said", F.lit(True)))
    marks = cut(features(files, texts).join(said, "file_id", "left").withColumn("known", F.col("upwards") | F.coalesce("said", F.lit(False))))
    lines = mined_lines(marks).withColumnRenamed("line", "template")
    wording = marks.select("file_id", F.explode("lines").alias("template")).join(lines, "template", "left_semi").select("file_id")
    names = cut(packages(files))
    # The folder below a vendor folder, or the name with a version, is a package that libraries prove to exist.
    folder = F.lower(F.regexp_extract("path", rf"(?i)(?:^|/){_VENDOR_DIR}/([A-Za-z][\w]*?)(?:-v?\d[\w.]*)?/", 1))
    lying = own.where("file_source <> 'library'").select("file_id", folder.alias("package")).join(names, "package", "left_semi").select("file_id")
    credited = marks.select("file_id", F.explode("credits").alias("package")).join(names, "package", "left_semi").select("file_id")
    copies = marks.where("not upwards and not minified and not blob").join(third_party_classes(marks.where("not upwards and not minified and not blob")), "cls", "left_semi").select("file_id")
    why = lambda df, reason: df.select("file_id").withColumn("reason", F.lit(reason))
    # Texts with too few shingles for near copies: those that equal a text of a library, word by word.
    few = marks.where("not upwards and not minified and not blob and size(shingles) = 0 and cls <> 0")
    same = few.join(few.where("library").select("cls").distinct(), "cls", "left_semi").select("file_id")
    parts = [
        why(own.where("file_source = 'library'"), "library"), why(said, "declared"), why(marks.where("upwards or banner"), "generated"), why(wording, "mined wording"),
        why(marks.where("minified"), "minified"), why(marks.where("blob"), "data"), why(lying, "vendored"), why(credited, "credited"), why(copies, "copy"), why(same, "copy"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("file_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons")).join(own.select("file_id"), "file_id", "left_semi")
