"""Aggregates, set operations and mutations over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the indices to a block of `coverage`.
BLOCK = 16


def sum_or_null(c: Column) -> Column:
    """The sum, NULL where any value is NULL, 0 for no rows."""
    return F.when(F.count("*") == F.count(c), F.coalesce(F.sum(c), F.lit(0)))


def ratio_or(value: Column, condition: Column, empty: float) -> Column:
    """Share of rows with the condition; `empty` for no rows."""
    return F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(empty))


def run_status(done: Column) -> Column:
    """none -> failed, all -> complete, any -> partial, else failed."""
    return F.when(F.count("*") == 0, "failed").when(F.every(done), "complete").when(F.some(done), "partial").otherwise("failed")


def best_per_key(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the best score of each key; the least `tie` wins."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(tie))).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def incomplete_groups(members: DataFrame, present: DataFrame, group: str, item: str) -> DataFrame:
    """(group) of which some items are present and some are missing."""
    known = present.select(item).distinct().withColumn("_has", F.lit(1))
    per = members.select(group, item).distinct().join(known, item, "left").groupBy(group).agg(F.count("*").alias("n"), F.count("_has").alias("k"))
    return per.where((F.col("k") > 0) & (F.col("k") < F.col("n"))).select(group)


def coverage(n: int, picks: DataFrame, col: str) -> DataFrame:
    """(idx, times) of what is wrong with picks that should hold every index of 0..n-1 once.

    The indices themselves are never shuffled, only the picks and one mark a block: each of these rows unrolls the indices that
    are missing between it and the next one of its block, at most 2**BLOCK.
    """
    spark, blocks = picks.sparkSession, max(0, n + (1 << BLOCK) - 1) >> BLOCK
    per = picks.groupBy(F.col(col).cast("long").alias("idx")).agg(F.count("*").alias("times")).select(F.shiftright("idx", BLOCK).alias("block"), "idx", "times")
    marks = spark.range(blocks).select(F.col("id").alias("block"), (F.shiftleft("id", BLOCK) - 1).alias("idx"), F.lit(None).cast("long").alias("times"))
    # A fixed number of parts: by the bytes shuffled, adaptive execution would join all that is to be unrolled into one task.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks >> 9)
    stop = F.lead("idx").over(Window.partitionBy("block").orderBy("idx"))
    ends = per.unionByName(marks).repartition(parts, "block").withColumn("stop", F.least(F.coalesce(stop, F.shiftleft(F.col("block") + 1, BLOCK)), F.lit(n)))
    mark, within = F.col("times").isNull(), F.coalesce(F.col("idx").between(0, n - 1), F.lit(False))
    missing = F.when(mark | within, F.struct((F.col("idx") + 1).alias("lo"), (F.col("stop") - 1).alias("hi"), F.lit(0).cast("long").alias("times")))
    wrong = F.when(~mark & (~within | (F.col("times") != 1)), F.struct(F.col("idx").alias("lo"), F.col("idx").alias("hi"), "times"))
    spans = ends.select(F.explode(F.array(missing, wrong)).alias("r")).where("r is not null and (r.lo is null or r.lo <= r.hi)")
    # The outer form keeps the row of picks without an index.
    return spans.select(F.explode_outer(F.sequence("r.lo", "r.hi")).alias("idx"), F.col("r.times").alias("times"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old_where_null: bool = True) -> DataFrame:
    """Rows by natural key: new values win, ids of old rows stay, new rows get ids after the greatest old one.

    The ids follow the order of the key, from a range sort, so that no single task numbers all rows.
    """
    from marlstone.operators.numbering import numbered

    values = [c for c in new.columns if c not in key]
    both = old.join(new.select(*key, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_new")), key, "full_outer")
    pick = (lambda c: F.coalesce(f"_{c}", c)) if keep_old_where_null else (lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)))
    rows = both.select("id", *key, *[pick(c).alias(c) for c in values])
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    fresh = numbered(rows.where("id is null"), *key).withColumn("id", F.lit(top) + 1 + F.col("num")).drop("num")
    return rows.where("id is not null").unionByName(fresh)


def replace_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All columns of rows that come again are overwritten, with NULLs too."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def add_counts(old: DataFrame, new: DataFrame, key: list[str], count: str) -> DataFrame:
    """Counts of both, summed by key."""
    return old.select(*key, count).unionByName(new.select(*key, count)).groupBy(*key).agg(F.sum(count).alias(count))


def delete_children(gone: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Every table without the rows of deleted files: {name: (table, columns that hold the file's id)}."""
    out = {}
    for name, (df, cols) in tables.items():
        for c in cols:
            df = df.join(gone.select(F.col("file_id").alias(c)), c, "left_anti")
        out[name] = df
    return out


def update_where_given(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """NULL fields of the update leave the old value."""
    values = [c for c in new.columns if c != key]
    return old.join(new.select(key, *[F.col(c).alias(f"_{c}") for c in values]), key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns])


def prefix_flag(df: DataFrame, prefixes: DataFrame, col: str, flag: str) -> DataFrame:
    """Flag rows whose `col` up to its last colon is among the prefixes: an equi-join instead of LIKE."""
    head = F.regexp_extract(col, r"^(.*?:(?:impl|test_impl):[^:]*):", 1)
    hit = prefixes.select(F.col("prefix").alias("_p")).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, head == F.col("_p"), "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_p", "_hit")


def last_not_null(c: str, *order: str, by: list[str]) -> Column:
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
