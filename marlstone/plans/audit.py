"""Scoring retrieval against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_to_regex(p: Column) -> Column:
    """A glob in which `*` crosses `/`."""
    quoted = F.regexp_replace(p, r"([.+^${}()|\\\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def matched_patterns(patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """`patterns` (task, role, pattern) with whether some path of the task matches, exactly or as a glob.

    The task is the join key; exact patterns are matched by equality, only those with wildcards row by row.
    """
    wild = F.col("pattern").rlike(r"[*?]")
    exact = patterns.where(~wild).join(paths.select("task", F.col("path").alias("pattern")).distinct(), ["task", "pattern"], "left_semi")
    globs = patterns.where(wild).alias("g").join(paths.alias("p"), (F.col("g.task") == F.col("p.task")) & F.expr("p.path rlike g.rx"), "left_semi") if "rx" in patterns.columns else patterns.where(wild).withColumn("rx", glob_to_regex(F.col("pattern"))).alias("g").join(paths.alias("p"), (F.col("g.task") == F.col("p.task")) & F.expr("p.path rlike g.rx"), "left_semi").select("g.task", "g.role", "g.pattern")
    hit = exact.select("task", "role", "pattern").unionByName(globs.select("task", "role", "pattern")).distinct().withColumn("hit", F.lit(True))
    return patterns.select("task", "role", "pattern").distinct().join(hit, ["task", "role", "pattern"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def scores(tasks: DataFrame, patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """Per task: recall of what must and should be there, accuracy of what must not; nothing asked gives 1.0."""
    m = matched_patterns(patterns, paths)
    share = lambda role: F.coalesce(F.avg(F.when(F.col("role") == role, F.col("hit").cast("double"))), F.lit(1.0))
    per = m.groupBy("task").agg(share("must").alias("must_recall"), share("should").alias("should_recall"), F.coalesce(1 - F.avg(F.when(F.col("role") == "must_not", F.col("hit").cast("double"))), F.lit(1.0)).alias("exclusion"))
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0)).alias(c)
    out = tasks.select("task").join(per, "task", "left").select("task", one("must_recall"), one("should_recall"), one("exclusion"))
    return out.withColumn("task_score", F.least("must_recall", "exclusion"))


def utilisation(total: Column, budget: Column) -> Column:
    return F.when(F.coalesce(budget, F.lit(0)) <= 0, F.lit(0.0)).otherwise(total / budget)


def suite(task_scores: DataFrame) -> DataFrame:
    """Means over tasks without an error, the worst task, how many failed."""
    ok = F.col("error").isNull() | (F.col("error") == "")
    return task_scores.agg(
        F.avg(F.when(ok, F.col("must_recall"))).alias("must_recall"), F.avg(F.when(ok, F.col("task_score"))).alias("task_score"),
        F.min_by("task", F.struct("task_score", "task")).alias("worst"), F.count_if(~ok).alias("failed"), F.count_if(F.col("task_score") < 0.5).alias("blocking"),
    )
