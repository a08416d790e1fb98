"""Documents as rows: sections of headed text and of rule lists, HTML pages, section metadata."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import slug


def lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, no, line) from 1."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\r?\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


def headed_sections(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, no, level, title, path, parent, start_line, content): sections under `#` headings; those without content fall away.

    A heading's extent ends at the next one (lead); the path is a fold over the headings before it, one array per text. A
    heading inside a fence counts too.
    """
    own = Window.partitionBy("id").orderBy("no")
    rows = lines(df, id_col, text).withColumn("mark", F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    heads = rows.withColumn("sec", F.sum(F.when(F.col("mark") != "", 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))).where("sec > 0")
    first = heads.where("mark <> ''").select("id", F.col("sec").cast("long").alias("sec"), F.length("mark").alias("level"), F.btrim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("title"), F.col("no").alias("start_line"))
    body = heads.where("mark = ''").groupBy("id", "sec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    # The nearest earlier heading of each lower level: one running value per level, no self-join.
    up = Window.partitionBy("id").orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, 7):
        first = first.withColumn(f"_l{k}", F.last(F.when(F.col("level") == k, F.struct("sec", F.col("title").alias("t"))), ignorenulls=True).over(up))
        for j in range(1, k):  # a heading of a higher rank closes the lower ones
            first = first.withColumn(f"_l{k}", F.when(F.col(f"_l{k}").isNotNull() & (F.col(f"_l{j}")["sec"] > F.col(f"_l{k}")["sec"]), F.lit(None)).otherwise(F.col(f"_l{k}")))
    above = F.filter(F.array(*[F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, 7)]), lambda x: x.isNotNull())
    out = first.withColumn("above", above).select(
        "id", F.col("sec").alias("no"), "level", "title", F.array_join(F.concat(F.transform("above", lambda x: slug(x["t"])), F.array(slug(F.col("title")))), "/").alias("path"),
        F.array_max(F.transform("above", lambda x: x["sec"])).alias("parent"), "start_line",
    )
    return out.join(body.withColumnRenamed("sec", "no"), ["id", "no"]).withColumn("content", F.btrim("content", F.lit(" \t\r\n"))).where("content <> ''")


def rule_list(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, category, rule, title, line): `- ABC12-C: title` items with the `##` heading that they stand under."""
    own = Window.partitionBy("id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(df, id_col, text).withColumn("category", F.last(F.nullif(F.regexp_extract("line", r"^##\s+(.+?)\s*$", 1), F.lit("")), ignorenulls=True).over(own))
    pat = r"^\s*[-*]\s+([A-Z]{2,}\d+-C)[:.]?\s+(.+?)\s*$"
    return rows.where(F.col("line").rlike(pat)).select("id", "category", F.regexp_extract("line", pat, 1).alias("rule"), F.regexp_extract("line", pat, 2).alias("title"), F.col("no").alias("line"))


def clean_section(c: Column) -> Column:
    """Without page numbers and headers; runs of blank lines are one."""
    kept = F.filter(F.split(c, "\r?\n"), lambda x: ~x.rlike(r"^\s*\d{1,4}\s*$") & ~x.rlike(r"^\s*\d+\s+[A-Z][A-Z ]+(?:CHAPTER|SECTION)\b|^\s*(?:CHAPTER|SECTION)\b.*\d+\s*$"))
    return F.btrim(F.regexp_replace(F.array_join(kept, "\n"), r"\n(?:[ \t]*\n){2,}", "\n\n"), F.lit("\n"))


# Words that point to a domain, in order of preference.
DOMAINS = {
    "pointers": ["pointer", "address", "dereference", "indirection", "->"],
    "memory_management": ["malloc", "calloc", "realloc", "free", "alloc", "memory", "heap", "stack", "storage duration"],
    "io": ["printf", "scanf", "fprintf", "fscanf", "fopen", "fclose", "fread", "fwrite", "stdin", "stdout", "stderr", "input", "output", "stream", "file", "getchar", "putchar", "fgets", "fputs"],
    "strings": ["string", "strlen", "strcpy", "strcat", "strcmp", "strncpy", "strncat", "strstr", "strtok", "char array", "null terminator"],
    "control_flow": ["if-else", "switch", "while", "for", "do-while", "break", "continue", "goto", "loop", "branch", "jump"],
    "data_types": ["int", "char", "float", "double", "long", "short", "unsigned", "signed", "enum", "typedef", "struct", "union", "size_t", "void", "type", "conversion", "cast"],
    "preprocessor": ["preprocessor", "#define", "#include", "#ifdef", "#ifndef", "#if", "#else", "#endif", "macro", "#pragma"],
    "concurrency": ["thread", "mutex", "lock", "semaphore", "atomic", "race condition", "deadlock", "concurrent", "pthread", "condition variable"],
    "networking": ["socket", "bind", "listen", "accept", "connect", "send", "recv", "tcp", "udp", "ip", "port", "network", "client", "server"],
    "systems": ["system call", "syscall", "process", "fork", "exec", "pipe", "signal", "interrupt", "kernel", "operating system", "os", "virtual memory", "page", "scheduling"],
    "data_structures": ["linked list", "tree", "hash table", "queue", "stack", "array", "table", "binary", "node", "graph"],
    "error_handling": ["error", "errno", "perror", "strerror", "exception", "assert", "abort", "exit"],
    "bit_operations": ["bitwise", "bit", "shift", "mask", "xor", "complement", "twos complement"],
}


def section_metadata(df: DataFrame, id_col: str, title: str, content: str) -> DataFrame:
    """(id, domain, concepts, headers, c_standard): the domain with most keyword hits, the first one wins ties, none gives NULL.

    Keywords match as substrings of the title and the first 500 characters, all in one projection.
    """
    head = F.lower(F.concat_ws(" ", title, F.left(content, F.lit(500))))
    hits = F.array(*[F.struct(F.lit(-k).alias("order"), F.lit(d).alias("domain"), sum(F.contains(F.col("_head"), F.lit(w)).cast("int") for w in ws).alias("n")) for k, (d, ws) in enumerate(DOMAINS.items())])
    words = F.array(*[F.when(F.contains(F.col("_head"), F.lit(w)), F.lit(w)) for ws in DOMAINS.values() for w in ws])
    top = F.array_max(F.transform("_hits", lambda x: F.struct(x["n"].alias("n"), x["order"].alias("order"), x["domain"].alias("domain"))))
    standard = F.nullif(F.upper(F.regexp_extract(F.left(content, F.lit(2000)), r"(?i)\b(c(?:89|90|99|11|17|23))\b", 1)), F.lit(""))
    return (
        df.withColumn("_head", head).withColumn("_hits", hits)
        .select(F.col(id_col).alias("id"), F.when(top["n"] > 0, top["domain"]).alias("domain"), F.array_sort(F.array_distinct(F.filter(words, lambda x: x.isNotNull()))).alias("concepts"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(r"<\w+\.h>"), F.lit(0)))).alias("headers"), standard.alias("c_standard"))
    )


class _Page(HTMLParser):
    """Text under h1 to h3, without navigation; code in fences."""

    def __init__(self) -> None:
        super().__init__()
        self.skip, self.code, self.head = 0, 0, ""
        self.sections: list[tuple[int, str, list[str]]] = [(0, "", [])]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("nav", "aside", "script", "style", "header", "footer"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3") and not self.skip:
            self.head = tag
            self.sections.append((int(tag[1]), "", []))
        elif tag == "pre" and not self.skip:
            self.code += 1
            self.sections[-1][2].append("\n```\n")
        elif tag == "li" and not self.skip:
            self.sections[-1][2].append("\n- ")
        elif tag in ("p", "br", "tr", "div"):
            self.sections[-1][2].append("\n")
        elif tag in ("td", "th"):
            self.sections[-1][2].append(" | ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("nav", "aside", "script", "style", "header", "footer"):
            self.skip = max(0, self.skip - 1)
        elif tag == self.head:
            self.head = ""
        elif tag == "pre" and self.code:
            self.code -= 1
            self.sections[-1][2].append("\n```\n")

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.head:
            level, title, body = self.sections[-1]
            self.sections[-1] = (level, title + data, body)
        else:
            self.sections[-1][2].append(data if self.code else " ".join(data.split()) + (" " if data[-1:].isspace() else "") if data.strip() else "")


def html_sections(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, no, level, title, content) of HTML pages, parsed in the workers."""
    kind = df.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b["id"], b["html"]):
                page = _Page()
                page.feed(text or "")
                page.close()
                n = 0
                for level, title, body in page.sections:
                    content = "\n".join(x.rstrip() for x in "".join(body).split("\n")).strip()
                    if content or title:
                        out.append((i, n, level, " ".join(title.split()), content))
                        n += 1
            yield pd.DataFrame(out, columns=["id", "no", "level", "title", "content"])

    return df.select(F.col(id_col).alias("id"), F.col(html).alias("html")).mapInPandas(parse, f"id {kind}, no int, level int, title string, content string")


REGISTRY = {"markdown": headed_sections, "rules": rule_list, "html": html_sections}


def book_sections(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, path, title, start_line, end_line): chapters, appendices and numbered sections of a book's plain text.

    A line is a heading where the line before is blank (lag) and it reads `CHAPTER n: Title`, `Appendix A: Title` or `n.m Title`;
    lines with dot leaders belong to a table of contents. The first heading of a path counts; its extent ends where the next
    heading starts (lead), the last one's with the text.
    """
    own = Window.partitionBy("id").orderBy("no")
    pat = r"(?i)^\s*(?:chapter\s+(\d+)|appendix\s+([A-Z])|(\d+(?:\.\d+)+))\s*[:.\-]?\s+(\S.{0,80}?)\s*$"
    rows = lines(df, id_col, text).withColumn("before", F.lag("line").over(own)).withColumn("last", F.max("no").over(Window.partitionBy("id")))
    heads = rows.where(F.col("line").rlike(pat) & ~F.col("line").rlike(r"\.{3,}|(?:\. ){3,}") & (F.col("before").isNull() | (F.trim("before") == "")))
    g = lambda k: F.nullif(F.regexp_extract("line", pat, k), F.lit(""))
    path = F.coalesce(F.concat(F.lit("chapter_"), g(1)), F.concat(F.lit("appendix_"), F.lower(g(2))), F.translate(g(3), ".", "_"))
    named = heads.select("id", "no", "last", path.alias("path"), F.btrim(F.regexp_extract("line", pat, 4)).alias("title"))
    first = named.groupBy("id", "path").agg(F.min_by(F.struct("no", "last", "title"), "no").alias("r")).select("id", "path", "r.*")
    return first.select("id", "path", "title", F.col("no").alias("start_line"), (F.coalesce(F.lead("no").over(own) - 1, F.col("last"))).alias("end_line"))


def bridge(sections: DataFrame, source: str, repo_id: int) -> dict[str, DataFrame]:
    """Three projections of sections (path, title, content): the sections, their files `kb/<source>/<path>`, and the files' metadata."""
    path = F.concat(F.lit(f"kb/{source}/"), "path")
    files = sections.select(F.lit(repo_id).cast("long").alias("repo_id"), path.alias("path"), F.lit("text").alias("language"), F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"), F.lit("knowledge_base").alias("file_source"))
    return {"sections": sections, "files": files, "metadata": sections.select(path.alias("path"), F.col("title").alias("purpose"), F.lit(source).alias("module"))}
