"""Relational core of planning and editing: grouping, adjustment, edits, error classes, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import apply_edits, toml_escape, undeclared_symbols
from marlstone.operators.graph import components
from marlstone.operators.numbering import numbered

# Headers that declare names of the C library.
HEADERS = {
    "stdio.h": "printf fprintf sprintf snprintf scanf fscanf sscanf fopen fclose fread fwrite fgets fputs puts getchar putchar fflush fseek ftell rewind perror remove rename tmpfile fgetc fputc ungetc feof ferror clearerr vprintf vfprintf vsprintf vsnprintf FILE EOF stdin stdout stderr",
    "stdlib.h": "malloc calloc realloc free atoi atol atof strtol strtoul strtod strtof strtold abs labs div ldiv rand srand exit abort atexit system getenv qsort bsearch EXIT_SUCCESS EXIT_FAILURE RAND_MAX NULL size_t",
    "string.h": "memcpy memmove memset memcmp memchr strlen strcpy strncpy strcat strncat strcmp strncmp strchr strrchr strstr strtok strerror strdup",
    "math.h": "sin cos tan asin acos atan atan2 sinh cosh tanh exp log log10 pow sqrt ceil floor fabs fmod round trunc INFINITY NAN HUGE_VAL M_PI",
    "ctype.h": "isalpha isdigit isalnum isspace isupper islower toupper tolower isprint ispunct isxdigit",
    "assert.h": "assert",
    "errno.h": "errno ERANGE EDOM",
    "limits.h": "INT_MAX INT_MIN UINT_MAX LONG_MAX LONG_MIN CHAR_MAX CHAR_MIN SCHAR_MAX",
    "stdbool.h": "bool true false",
    "stdint.h": "int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t SIZE_MAX INT64_MAX UINT64_MAX",
    "stddef.h": "ptrdiff_t offsetof",
    "time.h": "time clock difftime mktime strftime localtime gmtime time_t clock_t CLOCKS_PER_SEC",
    "signal.h": "signal raise SIGINT SIGTERM SIGSEGV",
    "setjmp.h": "setjmp longjmp jmp_buf",
}


def parts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, files, description): components of changes named p1..pn by their least member; the first description is kept."""
    c = components(edges, nodes.select("node")).join(nodes, "node")
    g = c.groupBy("component").agg(F.sort_array(F.collect_set("node")).alias("files"), F.min_by("description", "node").alias("description"))
    return numbered(g, "component").select(F.concat(F.lit("p"), F.col("num") + 1).alias("part"), "files", "description")


def adjust(steps: DataFrame, failures: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """Revised steps and unattributed failures. No steps left gives none; no failures leave all as they are.

    `verdicts` has step, failure (null for the viability question) and yes; a missing verdict excludes.
    """
    viable = steps.join(verdicts.where("failure is null and yes").select("step").distinct(), "step", "left_semi")
    if failures.isEmpty():
        return {"steps": steps, "pairs": verdicts.limit(0).select("step", "failure"), "unattributed": failures}
    causes = verdicts.where("failure is not null and yes").select("step", "failure").distinct()
    pairs = causes.join(viable.select("step"), "step", "left_semi").join(failures.select("failure"), "failure", "left_semi")
    return {"steps": viable, "pairs": pairs, "unattributed": failures.join(pairs.select("failure"), "failure", "left_anti")}


def simulate_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, ok): edits (path, pos, search, replace) in order; a text whose edit doesn't match once is left as it was."""
    e = edits.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "search", "replace"))), lambda x: F.struct(x["search"].alias("search"), x["replace"].alias("replace"))).alias("edits"))
    out = texts.join(e, "path", "left").withColumn("new", F.when(F.col("edits").isNull(), F.col("content")).otherwise(apply_edits(F.col("content"), F.col("edits"))))
    return out.select("path", F.coalesce("new", "content").alias("content"), F.col("new").isNotNull().alias("ok"))


def missing_headers(errors: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, symbol, header): of each compiler message (path, message) the first undeclared name that a header not yet included declares."""
    table = errors.sparkSession.createDataFrame([(s, f"<{h}>") for h, names in HEADERS.items() for s in names.split()], "symbol string, header string")
    e = errors.distinct().select("path", "message", F.posexplode(undeclared_symbols(F.col("message"))).alias("pos", "symbol"))
    hit = e.join(F.broadcast(table), "symbol")  # a fixed table
    open_ = hit.join(texts.select("path", "content"), "path").where(~F.contains("content", F.concat(F.lit("#include "), "header")))
    return open_.groupBy("path", "message").agg(F.min_by(F.struct("symbol", "header"), "pos").alias("first")).select("path", "first.symbol", "first.header").distinct()


def error_class(deterministic: Column, *answers: tuple[str, Column]) -> Column:
    """The rule's class, else the first yes of the asked classes, else logic_error."""
    out = F.lit("logic_error")
    for name, yes in reversed(answers):
        out = F.when(F.coalesce(yes, F.lit(False)), name).otherwise(out)
    return F.coalesce(deterministic, out)


def stub_return(kind: Column) -> Column:
    """What a stub of a return type returns."""
    t = F.regexp_replace(F.trim(kind), r"\b(?:static|inline|extern|const)\b\s*", "")
    return F.when(t == "void", "").when(F.endswith(t, F.lit("*")), "return NULL;").when(t.isin("float", "double"), "return 0.0;").when(t.isin("bool", "_Bool"), "return false;").otherwise("return 0;")


def findings_toml(rows: DataFrame) -> DataFrame:
    """(line) of a TOML table of findings (id, task, must_recall, score, note), metrics with two decimals."""
    text = F.concat_ws("\n", F.lit("[[finding]]"), F.format_string('id = "%s"', toml_escape(F.col("id"))), F.format_string('task = "%s"', toml_escape(F.col("task"))), F.format_string("must_recall = %.2f", "must_recall"), F.format_string("score = %.2f", "score"), F.format_string('note = "%s"', toml_escape(F.coalesce("note", F.lit("")))))
    return rows.select("id", text.alias("line"))


def unified_text(edits: DataFrame) -> DataFrame:
    """(path, text): edits as a diff-like text."""
    lines = lambda c, mark: F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(mark), x)), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path"), lines(F.col("search"), "-"), lines(F.col("replace"), "+"))
    return edits.select("path", "pos", body.alias("text")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


def session_blob(kv: DataFrame, task: str) -> DataFrame:
    """(task_id, session_blob): the latest value of each key as one binary document."""
    last = kv.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"))
    doc = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))))
    return last.agg(doc.cast("binary").alias("session_blob")).select(F.lit(task).alias("task_id"), "session_blob")


def restore_session(archives: DataFrame) -> DataFrame:
    """(task_id, key, value) of each task's latest archive."""
    last = archives.groupBy("task_id").agg(F.max_by("session_blob", "id").alias("blob"))
    return last.select("task_id", F.explode(F.from_json(F.col("blob").cast("string"), "map<string,string>")).alias("key", "value"))
