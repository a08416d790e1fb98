"""The flagship: files in scope of a task, tier by tier.

Tier 0 is the plan, 1 the seeds and the files of seed symbols, 2 what seeds import or are imported by, 3 what changes
together with them, 4 what matches the keywords. A tier only takes files that no lower tier has, and caps apply after that,
so the tiers are a chain of joins and can't be one union. Best score first, the file id breaks ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.lookup import symmetric
from marlstone.session import cut


def _capped(df: DataFrame, cap: int) -> DataFrame:
    """Top-k of a whole tier: TakeOrdered, so only k rows a task travel."""
    return df.orderBy(F.desc("score"), "file_id").limit(cap)


def fan_in(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(file_id, score): seeds that import a file and seeds that a file imports, counted apart; the greater number counts."""
    ends = F.array(F.struct(F.col("src").alias("seed"), F.col("dst").alias("file_id"), F.lit(0).alias("way")), F.struct(F.col("dst").alias("seed"), F.col("src").alias("file_id"), F.lit(1).alias("way")))
    met = edges.select(F.explode(ends).alias("e")).select("e.*").join(seeds.select(F.col("file_id").alias("seed")), "seed", "left_semi")
    return met.groupBy("file_id", "way").agg(F.countDistinct("seed").alias("score")).groupBy("file_id").agg(F.max("score").alias("score"))


def keyword_matches(meta: DataFrame, words: DataFrame, top: int = 5) -> DataFrame:
    """(file_id, score): the longest keywords (word, pos) that a file's concepts contain.

    Of the `top` longest (text order among equals) each scores ten times its length and one more for each kept word from it on.
    """
    best = words.orderBy(F.desc(F.length("word")), "pos").limit(top)  # at most `top` rows: one task may order them
    from_end = Window.orderBy(F.length("word"), F.desc("pos"))
    best = best.select("word", (F.length("word") * 10 + F.row_number().over(from_end)).alias("worth"))
    hits = meta.join(F.broadcast(best), F.contains(F.lower("concepts"), F.lower("word")))
    return hits.groupBy("file_id").agg(F.max("worth").alias("score"))


def expand_scope(plan: DataFrame, seeds: DataFrame, edges: DataFrame, co_changes: DataFrame, meta: DataFrame, words: DataFrame, max_deps: int = 30, max_co: int = 20, max_meta: int = 20, min_count: int = 2) -> DataFrame:
    """(file_id, tier, score): every file once, the lowest tier wins. Each tier is kept, so that none is computed again by the next."""
    base = cut(plan.select("file_id").withColumn("tier", F.lit(0)).unionByName(seeds.select("file_id").withColumn("tier", F.lit(1))).groupBy("file_id").agg(F.min("tier").alias("tier")).withColumn("score", F.lit(None).cast("long")))
    start = base.select("file_id")
    t2 = cut(_capped(fan_in(edges, start).join(start, "file_id", "left_anti"), max_deps).withColumn("tier", F.lit(2)))
    have = start.unionByName(t2.select("file_id"))
    near = symmetric(co_changes.where(F.col("n") >= min_count), "a", "b", "n")
    t3 = near.join(start.withColumnRenamed("file_id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("file_id")).agg(F.max("n").alias("score"))
    t3 = cut(_capped(t3.join(have, "file_id", "left_anti"), max_co).withColumn("tier", F.lit(3)))
    have = have.unionByName(t3.select("file_id"))
    t4 = _capped(keyword_matches(meta, words).join(have, "file_id", "left_anti"), max_meta).withColumn("tier", F.lit(4))
    out = base
    for t in (t2, t3, t4):
        out = out.unionByName(t.select("file_id", "tier", F.col("score").cast("long").alias("score")))
    return out


def precision(scope: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(file_id, level): three yes-no passes; a missing verdict denies. Library files are type context at once."""
    j = scope.join(verdicts, "file_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    level = F.when(F.col("library"), "type_context").when(~yes("relevant"), "excluded").when(yes("primary"), "primary").when(yes("supporting"), "supporting").otherwise("type_context")
    return j.select("file_id", level.alias("level"))


def merge_decisions(log: DataFrame) -> DataFrame:
    """The first decision about each file stays in the log, as stages add theirs."""
    return log.withColumn("_k", F.row_number().over(Window.partitionBy("file_id").orderBy("stage"))).where("_k = 1").drop("_k")
