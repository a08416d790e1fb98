"""Graphs: breadth-first expansion, components, levels, plan checks, interval merging.

Rounds are joins; what a round finds is cut with a reliable checkpoint, and the driver only asks whether it is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.lookup import symmetric
from marlstone.session import cut


def expand(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hops): undirected reach of `seeds` (node) within `depth` hops; hops is the least number."""
    both = cut(symmetric(edges, "src", "dst").select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct())
    seen = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, depth + 1):
        front = cut(both.join(front.select("node"), "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def edges_within(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The edges met while expanding: those with an end in fewer than `depth` hops, once each by edge id; depth 0 has none."""
    if depth <= 0:
        return edges.limit(0)
    near = expand(edges, seeds, depth - 1).select("node")
    a = edges.join(near, edges["src"] == near["node"], "left_semi")
    b = edges.join(near, edges["dst"] == near["node"], "left_semi")
    return a.unionByName(b).dropDuplicates(["id"])


def _mark(pairs: DataFrame) -> tuple:
    """Count and two independent hash sums of a set of pairs: tells, without a shuffle, whether a round changed it."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node of each connected component, by large-star and small-star rounds.

    The rounds grow with the logarithm of the diameter, and no node's neighbours are gathered in a list: a hot node's
    minimum is a partial aggregate.
    """
    pairs = cut(edges.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u")).where("u <> v").distinct())
    mark = _mark(pairs)
    while True:
        # Large star: every larger neighbour of u is tied to the least of u's neighbourhood.
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every smaller neighbour of u, and u, are tied to the least of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = cut(large.join(low2, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        pairs, before, mark = small.select("v", "u"), mark, _mark(small)
        if mark == before:
            break
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    if nodes is not None:
        alone = nodes.select("node").distinct().join(out, "node", "left_anti")
        out = out.unionByName(alone.withColumn("component", F.col("node")))
    return out


def levels(nodes: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, level), left over): 0 needs nothing, else one more than the highest level needed; unknown needs are ignored.

    What is left over lies on or behind a cycle.
    """
    known = nodes.select("node").distinct()
    edges = cut(needs.select("node", "needs").distinct().join(known, "node", "left_semi").join(known.withColumnRenamed("node", "needs"), "needs", "left_semi"))
    left, done, level = cut(known), None, 0
    while True:
        blocked = edges.join(left.withColumnRenamed("node", "needs"), "needs", "left_semi").select("node").distinct()
        free = cut(left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            return (done if done is not None else free), left
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(free, "node", "left_anti"))
        level += 1


def plan_warnings(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(kind, node): duplicate ids, dangling needs, nodes on or behind a cycle."""
    twice = nodes.groupBy("node").count().where("count > 1").select(F.lit("duplicate").alias("kind"), "node")
    dangling = needs.select(F.col("needs").alias("node")).distinct().join(nodes, "node", "left_anti").select(F.lit("dangling").alias("kind"), "node")
    _, left = levels(nodes, needs)
    return twice.unionByName(dangling).unionByName(left.select(F.lit("cycle").alias("kind"), "node"))


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals of each key that overlap or touch, merged: gaps and islands over the running greatest end."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_island", island).groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
