"""Items that appear together: exact pair counts from sorted 64-bit pair codes.

Rows -> baskets of distinct items -> a dense 32-bit number per item (its place in the order of group and item) ->
one 64-bit code per pair -> every task sorts its codes (Spark's external sort spills sorted runs and merges them) and
counts runs -> the (code, count) runs are shuffled by code, sorted and counted again -> thresholds and odds ratios.

Defined results: rows with a null group or basket key are ignored, null items too; an empty or null item list is an
empty basket, which doesn't count; a basket key that comes again is one basket holding the union of its items; order and
repeats inside a list don't matter. Other columns are never read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.numbering import numbered
from marlstone.session import cut

MAX_ITEMS = 50
MIN_TOGETHER = 4
MIN_LIFT = 3


def clean_path(c: Column) -> Column:
    """`/` for `\\`, no leading `./`."""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(?:\./+)+", "")


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of equal neighbouring codes; a run that a batch border cuts is carried over."""
    code, count = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column(0).to_numpy(zero_copy_only=False)
        ones = b.column(1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        sums, keys = np.add.reduceat(ones, starts), codes[starts]
        if code is not None and keys[0] == code:
            sums[0] += count
        elif code is not None:
            keys, sums = np.r_[code, keys], np.r_[count, sums]
        code, count = keys[-1], sums[-1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1], pa.int64()), pa.array(sums[:-1], pa.int64())], ["code", "k"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], ["code", "k"])


def baskets(df: DataFrame, group: str, key: str, items: Column, max_items: int | None = MAX_ITEMS) -> DataFrame:
    """(group, key, items): one row per basket with 1 to `max_items` distinct items, without a bound where it is None."""
    own = F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
    return (
        df.select(F.col(group).alias("grp"), F.col(key).alias("bkey"), F.coalesce(own, F.array().cast("array<string>")).alias("own"))
        .where(F.col("grp").isNotNull() & F.col("bkey").isNotNull())
        .groupBy("grp", "bkey")
        .agg(F.array_distinct(F.flatten(F.collect_set("own"))).alias("items"))  # equal rows fold before the shuffle
        .where(F.size("items").between(1, max_items) if max_items else F.size("items") > 0)
    )


def pair_counts(df: DataFrame, group: str, key: str, items: Column, max_items: int | None = MAX_ITEMS, min_together: int = MIN_TOGETHER, min_lift: int | None = MIN_LIFT) -> DataFrame:
    """(grp, item_a, item_b, k, a, b, n, lift, odds_ratio), item_a < item_b in byte order.

    k baskets hold both, a and b hold the one and the other, n is the group's baskets. Kept are k >= min_together and
    k*n >= min_lift*a*b. As k <= min(a, b), items with a < min_together or min_lift*a > n can't be in such a pair and are
    left out before any pair is made; that is exact. odds_ratio has 0.5 added to each of the four cells.
    """
    base = cut(baskets(df, group, key, items, max_items))
    rows = base.select("grp", "bkey", F.explode("items").alias("item"))
    sizes = base.groupBy("grp").agg(F.count("*").alias("n"))
    single = rows.groupBy("grp", "item").agg(F.count("*").alias("a")).where(F.col("a") >= min_together).join(sizes, "grp")
    if min_lift:
        single = single.where(min_lift * F.col("a") <= F.col("n"))
    fits = F.when(F.col("num") < 1 << 31, F.col("num")).otherwise(F.raise_error(F.lit("more items than a code's half can number")))
    names = cut(numbered(single, "grp", "item").withColumn("num", fits.cast("long")))
    coded = rows.join(names.select("grp", "item", "num"), ["grp", "item"]).groupBy("grp", "bkey").agg(F.sort_array(F.collect_list("num")).alias("nums")).where(F.size("nums") > 1)
    both = F.expr("flatten(transform(nums, (x, i) -> transform(slice(nums, i + 2, size(nums)), y -> shiftleft(x, 32) | y)))")
    codes = coded.select(F.explode(both).alias("code"), F.lit(1).cast("long").alias("k"))
    runs = codes.sortWithinPartitions("code").mapInArrow(_run_lengths, "code long, k long")
    total = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_run_lengths, "code long, k long").where(F.col("k") >= min_together)
    pairs = total.select(F.shiftright("code", 32).alias("num_a"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("num_b"), "k")
    one = names.select(F.col("num").alias("num_a"), "grp", F.col("item").alias("item_a"), "a", "n")
    two = names.select(F.col("num").alias("num_b"), F.col("item").alias("item_b"), F.col("a").alias("b"))
    out = pairs.join(one, "num_a").join(two, "num_b")
    if min_lift:
        out = out.where(F.col("k") * F.col("n") >= min_lift * F.col("a") * F.col("b"))
    k, a, b, n = (F.col(c).cast("double") for c in "kabn")
    odds = ((k + 0.5) * (n - a - b + k + 0.5)) / ((a - k + 0.5) * (b - k + 0.5))
    return out.select("grp", "item_a", "item_b", "k", "a", "b", "n", (k * n / (a * b)).alias("lift"), odds.alias("odds_ratio"))


def commit_pairs(commits: DataFrame) -> DataFrame:
    """Co-changed paths of each repository, with their counts and how far they are beyond chance."""
    paths = F.transform(F.col("changed_files"), clean_path)
    return pair_counts(commits, "repo_id", "hash", paths).withColumnsRenamed({"grp": "repo_id", "item_a": "path_a", "item_b": "path_b"})
