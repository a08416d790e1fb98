"""Text functions as column expressions: extraction, classification, cleaning, budgets, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of the languages indexed.
LANGUAGE_OF = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".c": "c", ".h": "c"}
_ENDINGS = "tsx|ts|jsx|js|mjs|cjs|py|c|h"


def language(path: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.element_at(m, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def like_escape(s: Column) -> Column:
    """`\\`, `%` and `_` escaped for LIKE."""
    return F.regexp_replace(s, r"([\\%_])", r"\\$1")


# Letters and digits of any script, as words have them: Java's \w knows ASCII only.
_W = r"\p{L}\p{N}_"
_PATH = rf"(?m)(?:^|[\s'\"`(\x7b,])([a-zA-Z0-9_./-]+\.(?:{_ENDINGS}))(?:[\s'\"`)\x7d,:;]|$)"
_NAMES = (r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b", r"\b([A-Za-z]\w+\.[a-z_]\w+)\b")
_ERROR = r"^.*(?:Error:|Exception:|Traceback|at line)\s*.*$"
_TASK_WORD = rf"(?:^|[^{_W}])([a-zA-Z_][{_W}]*)"


def file_paths(text: Column) -> Column:
    """Paths in a text, between delimiters; the delimiter is used up, so of two paths one blank apart the first is found."""
    return F.regexp_extract_all(text, F.lit(_PATH), F.lit(1))


def symbol_names(text: Column) -> Column:
    """CamelCase, snake_case and dotted names, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _NAMES])))


def error_lines(text: Column) -> Column:
    """Lines that report an error; one that ends with the mark takes the next line along."""
    return F.regexp_extract_all(text, F.lit("(?dim)" + _ERROR), F.lit(0))


# Words that are no keywords.
STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need to of in "
    "for on with at by from as into through during before after above below between out off over under again further then once here there "
    "when where why how all each every both few more most other some such no nor not only own same so than too very just because but "
    "and or if while about up it its this that these those i me my we our you your he she they them what which who whom"
).split()


def task_words(text: Column) -> Column:
    """Lower-case words in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TASK_WORD), F.lit(1)))


def keywords(text: Column) -> Column:
    """Words longer than two letters, without stop words and what else was taken out of the text: paths, names, error lines."""
    taken = F.transform(F.concat(file_paths(text), symbol_names(text), error_lines(text)), lambda x: F.lower(x))
    return F.array_except(F.array_except(F.filter(task_words(text), lambda w: F.length(w) > 2), taken), F.array(*[F.lit(w) for w in STOP]))


def first_rule(words: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The first rule that shares a word."""
    out = F.lit(default)
    for name, ws in reversed(list(rules.items())):
        out = F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws])), name).otherwise(out)
    return out


# Rules of the task types in order.
TASK_RULES = {
    "bug_fix": ["fix", "bug", "broken", "crash", "error", "issue", "wrong", "fail"],
    "feature": ["add", "implement", "create", "new", "feature", "build", "introduce"],
    "refactor": ["refactor", "rename", "restructure", "reorganize", "move", "extract", "clean"],
    "test": ["test", "spec", "coverage", "assert", "unittest", "pytest"],
    "docs": ["doc", "docs", "document", "readme", "comment", "docstring"],
}


def task_type(text: Column) -> Column:
    return first_rule(task_words(text), TASK_RULES, "unknown")


def comment_kind(c: Column) -> Column:
    """todo > fixme > hack > note > bug_ref > rationale > general; a colon form of rationale needs a word right after it."""
    low = F.lower(c)
    return (
        F.when(low.rlike(r"\btodo\b"), "todo").when(low.rlike(r"\bfixme\b"), "fixme").when(low.rlike(r"\bhack\b"), "hack").when(low.rlike(r"\bnote\b"), "note")
        .when(low.rlike(r"\b(?:bug|issue|ticket)[-\s]?#?\d+|#\d+\b"), "bug_ref")
        .when(low.rlike(r"\bbecause\b|\bsince\b|\bin order to\b|\bso that\b|\b(?:reason|why|rationale):\b"), "rationale").otherwise("general")
    )


def docstring_format(c: Column) -> Column:
    return (
        F.when(c.rlike(r"(?m)^\s*(?:Args|Arguments|Returns|Raises|Yields|Attributes|Example|Examples|Note):\s*$"), "google")
        .when(c.rlike(r"(?m)^\s*(?:Parameters|Returns|Raises|Yields|Attributes)[ \t]*\r?\n\s*-{3,}"), "numpy")
        .when(c.rlike(r"(?m)^\s*:(?:param|type|returns?|rtype|raises)\b"), "sphinx").otherwise("plain")
    )


# How failures are told, in order of precedence.
FAILURES = {
    "compile_error": ["error:.*expected|undefined reference|implicit declaration", "gcc|clang|cc1|ld:.*error", "syntax error|parse error|redefinition"],
    "test_failure": ["FAIL|FAILED|AssertionError|assert.*failed", r"test_\w+.*FAILED|pytest.*failed"],
    "patch_failure": ["Patch.*failed|search.*not found|could not find"],
}
# How compilers tell that a name isn't declared, in order of precedence.
UNDECLARED = [r"implicit declaration of function ['\"](\w+)['\"]", r"(?:use of undeclared identifier|'(\w+)' undeclared)", r"unknown type name ['\"](\w+)['\"]"]


def failure_category(t: Column) -> Column:
    out = F.lit("unknown")
    for name, patterns in reversed(list(FAILURES.items())):
        out = F.when(t.rlike("(?di)" + "|".join(patterns)), name).otherwise(out)
    return out


def failing_tests(t: Column) -> Column:
    """What pytest's FAILED names, else what jest's FAIL does, in order."""
    a, b = (F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (r"FAILED\s+(\S+)", r"FAIL\s+(\S+)"))
    return F.when(F.size(a) > 0, a).otherwise(b)


def undeclared_symbols(t: Column) -> Column:
    """The names that a compiler doesn't know: the first of each wording, in order of precedence."""
    names = F.array(*[F.nullif(F.regexp_extract(t, "(?i)" + p, 1), F.lit("")) for p in UNDECLARED])
    return F.array_compact(names)


def strip_thinking(t: Column, tag: str = "think") -> Column:
    """Without the stretch from the first opening tag to the last closing one; without a closing one, to the end."""
    head = F.regexp_extract(t, rf"(?s)^(.*?)<{tag}>", 1)
    tail = F.when(t.rlike(rf"</{tag}>"), F.regexp_extract(t, rf"(?s)^.*</{tag}>(.*)$", 1)).otherwise("")
    return F.when(F.contains(t, F.lit(f"<{tag}>")), F.trim(F.concat(head, tail))).otherwise(t)


def strip_fence(t: Column) -> Column:
    """The inside of one layer of code fence."""
    inner = F.regexp_extract(F.trim(t), r"(?s)^```[a-zA-Z]*\s*\n(.*?)\n?```\s*$", 1)
    return F.when(F.trim(t).rlike(r"(?s)^```[a-zA-Z]*\s*\n.*?\n?```\s*$"), inner).otherwise(t)


def slug(t: Column) -> Column:
    return F.left(F.btrim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(60))


def keep_tail(t: Column, n: int) -> Column:
    return F.right(t, F.lit(n))


def keep_head(t: Column, n: int) -> Column:
    return F.left(t, F.lit(n))


def tree_line(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.concat(F.repeat(F.lit("  "), F.size(parts) - 1), F.element_at(parts, -1))


def clean_jsdoc(c: Column) -> Column:
    """Documentation text without its comment marks."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"^\s*/\*\*+|\*+/\s*$", ""), r"(?m)^[ \t]*\*(?!/)[ \t]?", ""))


def unescape(c: Column) -> Column:
    """The common named entities; the ampersand last."""
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("#39", "'"), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"), ("copy", "©"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(value))
    return c


def toml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def answer(t: Column) -> Column:
    """(verdict, omitted): yes or no, else JSON with `verdict` or `keep`; anything else denies and counts as omitted."""
    low = F.lower(F.btrim(F.trim(t), F.lit(".!")))
    j = F.from_json(F.trim(t), "verdict string, keep string")
    said = F.coalesce(F.lower(j["verdict"]), F.lower(j["keep"]))
    ok = F.when(low == "yes", True).when(low == "no", False).when(said.isNotNull(), said.isin("relevant", "yes", "true"))
    return F.struct(F.coalesce(ok, F.lit(False)).alias("verdict"), ok.isNull().alias("omitted"))


def jsdoc_tags(c: Column) -> Column:
    """map(tag -> values) of a documentation comment, in order of use."""
    tags = F.regexp_extract_all(c, F.lit(r"(?m)^\s*@(\w+)[ \t]*(.*)$"), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(r"(?m)^\s*@(\w+)[ \t]*(.*)$"), F.lit(2))
    pairs = F.arrays_zip(tags.alias("t"), values.alias("v"))
    keys = F.array_distinct(tags)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["t"] == k), lambda p: p["v"])))


def edit_blocks(t: Column) -> Column:
    """array<struct<path, search, replace>> of `<edit file="...">` blocks; one line break is trimmed at either end."""
    pat = r"(?s)<edit\s+file=\"([^\"]+)\">.*?<search>\n?(.*?)\n?</search>.*?<replacement>\n?(.*?)\n?</replacement>.*?</edit>"
    a, b, c = (F.regexp_extract_all(t, F.lit(pat), F.lit(k)) for k in (1, 2, 3))
    return F.transform(F.arrays_zip(a.alias("path"), b.alias("search"), c.alias("replace")), lambda x: F.struct(x["path"].alias("path"), x["search"].alias("search"), x["replace"].alias("replace")))


def apply_edits(text: Column, edits: Column) -> Column:
    """The text after edits (search, replace) in order; null as soon as a search text doesn't occur exactly once."""
    times = lambda s, x: (F.length(s) - F.length(F.replace(s, x, F.lit("")))) / F.length(x)
    return F.aggregate(edits, text, lambda acc, e: F.when((F.length(e["search"]) > 0) & (times(acc, e["search"]) == 1), F.replace(acc, e["search"], e["replace"])))


def include_line(text: Column, header: Column) -> Column:
    """The text with an include line after its last one; nothing changes where it is there already."""
    line = F.concat(F.lit("#include "), header)
    lines = F.split(text, "\n")
    places = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(r"^\s*#\s*include\b"))
    last = F.coalesce(F.array_max(places), F.lit(0))
    return F.when(F.contains(text, line), text).otherwise(F.array_join(F.concat(F.slice(lines, F.lit(1), last), F.array(line), F.slice(lines, last + 1, F.size(lines))), "\n"))


def fence_for(t: Column) -> Column:
    """A code fence longer than any run of backticks inside."""
    runs = F.transform(F.regexp_extract_all(t, F.lit("`+"), F.lit(0)), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
