"""The pN_ queries, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.catalog import table
from marlstone.llm import cooccur, functions, leaks, natural, packing, pairs, parsing, provenance, splitting
from marlstone.registry import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = prepared(f)
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


_P6 = r"""
WITH one AS (SELECT repo_id, hash, list_distinct(list_filter(list_transform(coalesce(changed_files, []),
         lambda p: regexp_replace(replace(p, '\', '/'), '^(\./+)+', '')), lambda p: p IS NOT NULL AND p <> '')) AS p
       FROM commits WHERE repo_id IS NOT NULL AND hash IS NOT NULL),
paths AS (SELECT DISTINCT repo_id, hash, unnest(p) AS path FROM one),
base AS (SELECT repo_id, hash FROM paths GROUP BY 1, 2 HAVING count(*) BETWEEN 1 AND 50),
ok AS (SELECT paths.* FROM paths JOIN base USING (repo_id, hash)),
n AS (SELECT repo_id, count(*) AS n FROM base GROUP BY 1),
s AS (SELECT repo_id, path, count(*) AS c FROM ok GROUP BY 1, 2),
k AS (SELECT x.repo_id, x.path AS path_a, y.path AS path_b, count(*) AS k FROM ok x JOIN ok y
      ON x.repo_id = y.repo_id AND x.hash = y.hash AND x.path < y.path GROUP BY 1, 2, 3 HAVING count(*) >= 4),
r AS (SELECT k.repo_id, path_a, path_b, k.k, sa.c AS a, sb.c AS b, n.n FROM k
      JOIN s sa ON sa.repo_id = k.repo_id AND sa.path = path_a JOIN s sb ON sb.repo_id = k.repo_id AND sb.path = path_b
      JOIN n ON n.repo_id = k.repo_id WHERE k.k * n.n >= 3 * sa.c * sb.c)
"""


@query("p6_found", _P6 + "SELECT repo_id, path_a, path_b FROM r")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return cooccur.commit_pairs(table(spark, sf, "commits")).select("repo_id", "path_a", "path_b")


@query("p6_pairs", _P6 + "SELECT repo_id, path_a, path_b, k, a, b, n, round(k * n / (a * b), 6) AS lift, round((k + 0.5) * (n - a - b + k + 0.5) / ((a - k + 0.5) * (b - k + 0.5)), 6) AS odds_ratio FROM r")
def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cooccur.commit_pairs(table(spark, sf, "commits")).withColumns({c: F.round(c, 6) for c in ("lift", "odds_ratio")})


_TOKEN_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("p7_found", f"SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(text, '{_TOKEN_SQL}')) > 1024")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"))
    return packed.where(F.col("pieces") > 1).select(F.col("id").alias("doc_id")).distinct()


@query(
    "p7_filled",
    f"""WITH t AS (SELECT len(regexp_extract_all(coalesce(text, ''), '{_TOKEN_SQL}')) AS n FROM documents) SELECT count(*) AS texts, sum(n)::BIGINT AS tokens, sum(greatest(1, ceil(n / 1024)))::BIGINT AS pieces,
    1024::BIGINT AS fullest, true AS within_a_thousandth FROM t""",
)
def p7_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Every token lies in one container, none is too full, and there are at most a thousandth (or one) more than the tokens need."""
    packed = packing.pack(table(spark, sf, "documents"))
    boxes = packed.where("tokens > 0").groupBy("container").agg(F.sum("tokens").alias("full"))
    boxes = boxes.agg(F.max("full").alias("fullest"), F.count("*").alias("n"))
    whole = packed.agg(F.sum(F.when(F.col("piece") == 0, 1)).alias("texts"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    need = F.ceil(F.col("tokens") / packing.CAPACITY)
    return whole.crossJoin(boxes).select("texts", "tokens", "pieces", "fullest", (F.col("n") <= need + F.greatest(F.lit(1), F.ceil(need / 1000))).alias("within_a_thousandth"))


@query("p7_containers")
def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query(
    "p9_found",
    rf"""WITH p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\r?\n(?:[ \t]*\r?\n)+'),
           lambda x: len(regexp_extract_all(x, '{_TOKEN_SQL}')) > 0)) AS t, generate_subscripts(list_filter(regexp_split_to_array(text, '\r?\n(?:[ \t]*\r?\n)+'),
           lambda x: len(regexp_extract_all(x, '{_TOKEN_SQL}')) > 0), 1) AS para_no FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT doc_id, para_no FROM p WHERE len(regexp_extract_all(t, '{_TOKEN_SQL}')) > 256""",
)
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.paragraphs(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "para_no")


@query(
    "p9_cover",
    f"""WITH t AS (SELECT DISTINCT doc_id, len(regexp_extract_all(text, '{_TOKEN_SQL}')) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, n::BIGINT AS new_tokens, true AS ordered, true AS within_limit, true AS overlaps, n <= 256 AS whole FROM t WHERE n > 0""",
)
def p9_cover(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of a text hold every token as new once and in order, keep the limit, and overlap by what they say."""
    before = Window.partitionBy("id").orderBy("piece_no")
    last = F.lag("end").over(before)
    rows = splitting.split(table(spark, sf, "documents")).withColumns({"ok_order": last.isNull() | (F.col("end") > last), "ok_overlap": F.when(last.isNull(), F.col("shared") == 0).otherwise((F.col("shared") > 0) == (F.col("start") < last))})
    per = rows.groupBy("id").agg(
        F.sum(F.col("tokens") - F.col("shared")).alias("new_tokens"), F.bool_and("ok_order").alias("ordered"), F.bool_and((F.col("tokens") <= splitting.LIMIT) & (F.col("tokens") > F.col("shared"))).alias("within_limit"),
        F.bool_and(F.col("ok_overlap") & F.col("shared").between(0, splitting.OVERLAP)).alias("overlaps"), (F.count("*") == 1).alias("whole"),
    )
    return per.withColumnRenamed("id", "doc_id")


@query("p9_pieces")
def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(table(spark, sf, "retrieval_llm_calls")).withColumnRenamed("id", "call_id")


def _sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "files"), table(spark, sf, "source_texts")


@query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return natural.lines(*_sources(spark, sf), table(spark, sf, "inline_comments"))


@query("p3_shares")
def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    return natural.shares(*_sources(spark, sf), table(spark, sf, "inline_comments"))


@query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return functions.pairs(table(spark, sf, "symbols"), table(spark, sf, "docstrings"), *_sources(spark, sf)).select("symbol_id", "docstring_id").distinct()


@query("p2_documented")
def p2_documented(spark: SparkSession, sf: str) -> DataFrame:
    return functions.documented(*_sources(spark, sf))


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.not_hand_written(*_sources(spark, sf)).select("file_id")


@query("p4_reasons")
def p4_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.not_hand_written(*_sources(spark, sf))


@query("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


@query("p8_leaked_items")
def p8_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks.find(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max(F.round(F.col("held") / F.col("words"), 6)).alias("most_held"))


@query("p8_matches")
def p8_matches(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.longest_matches(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


@query("p8_clean")
def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.clean(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id")


@query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.broken(*_sources(spark, sf))


@query("p1_rates")
def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.rates(*_sources(spark, sf), table(spark, sf, "index_runs"))
