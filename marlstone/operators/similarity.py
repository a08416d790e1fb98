"""Pairwise similarity of symbols: line counts, callees, names, parents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one row of the classic table is one integer, a bit per letter of `a`."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence over the longer length; 0 where both are empty or one is null."""
    return pd.Series([lcs(x, y) / max(len(x), len(y)) if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """0.0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def pair_signals(symbols: DataFrame, block: list[str]) -> DataFrame:
    """(a, b, na, nb, line_ratio, callees, same_parent) of pairs a < b of the same block; a missing parent equals nothing.

    `symbols` has id, name, lines, callees (array), parent. The block columns (a kind and a small scope) are the join keys
    and keep the number of pairs in check.
    """
    x, y = symbols.alias("x"), symbols.alias("y")
    pairs = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in block] + [F.col("x.id") < F.col("y.id")])
    lines = F.least("x.lines", "y.lines") / F.greatest("x.lines", "y.lines")
    return pairs.select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.name").alias("na"), F.col("y.name").alias("nb"), lines.alias("line_ratio"),
        jaccard(F.col("x.callees"), F.col("y.callees")).alias("callees"), F.coalesce((F.col("x.parent") == F.col("y.parent")).cast("double"), F.lit(0.0)).alias("same_parent"),
    )


def similar_pairs(symbols: DataFrame, block: list[str], least: float = 0.3) -> DataFrame:
    """(a, b, signals, score): pairs with 0.3 lines + 0.35 callees + 0.2 names + 0.15 parents >= least.

    The cheap signals are tried first: a pair that can't reach `least` with equal names isn't compared letter by letter.
    """
    without = 0.3 * F.col("line_ratio") + 0.35 * F.col("callees") + 0.15 * F.col("same_parent")
    pairs = pair_signals(symbols, block).where(without + 0.2 >= least).withColumn("name_lcs", lcs_ratio(F.col("na"), F.col("nb")))
    return pairs.withColumn("score", without + 0.2 * F.col("name_lcs")).where(F.col("score") >= least).drop("na", "nb")
