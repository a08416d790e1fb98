"""Version history: log parsing, co-changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def co_changes(tracked: DataFrame, commit: str, item: str, max_items: int = 50, min_count: int = 2) -> DataFrame:
    """(a, b, n): pairs a < b of items of one commit, for commits with 2 to `max_items` distinct items.

    The cap comes before the pairs are made; pairs are made inside each commit's array, and are counted before they are
    shuffled. Items seen in fewer than `min_count` commits can't be in a pair that counts and are left out first.
    """
    rows = tracked.select(commit, item).distinct()
    fit = rows.groupBy(commit).agg(F.count("*").alias("_n")).where(F.col("_n").between(2, max_items)).select(commit)
    sized = rows.join(fit, commit, "left_semi")  # counted first: a giant commit is never gathered anywhere
    often = sized.groupBy(item).agg(F.count("*").alias("_c")).where(F.col("_c") >= min_count).select(item)
    arrays = sized.join(often, item, "left_semi").groupBy(commit).agg(F.sort_array(F.collect_list(item)).alias("items"))
    pairs = F.expr("flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> struct(x as a, y as b))))")
    return arrays.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def parse_log(text: Column) -> Column:
    """A log record: four header lines (hash, author, subject, time), then insertions, deletions and path by tabs.

    `-` counts 0; null where the header is incomplete.
    """
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    stats = F.transform(F.filter(F.slice(lines, 5, F.greatest(F.lit(0), F.size(lines) - 4)), lambda x: F.size(F.split(x, "\t")) >= 3), lambda x: F.split(x, "\t"))
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    total = lambda k: F.aggregate(stats, F.lit(0).cast("long"), lambda acc, x: acc + number(x[k]))
    return F.when(
        F.size(lines) >= 4,
        F.struct(lines[0].alias("hash"), lines[1].alias("author"), lines[2].alias("subject"), lines[3].alias("at"), total(0).alias("insertions"), total(1).alias("deletions"), F.size(stats).alias("files_changed"), F.transform(stats, lambda x: F.translate(x[2], "\\", "/")).alias("paths")),
    )
