"""The read API over the index: filters, batched lookups and neighbours, all set-at-a-time.

Ids to look up arrive as a DataFrame, so that a thousand lookups are one join. An empty string is no filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_ci(text: Column, part: Column | str) -> Column:
    """Case-insensitive substring; `%`, `_` and `\\` have no special meaning."""
    return F.contains(F.lower(text), F.lower(F.lit(part) if isinstance(part, str) else part))


def files_of(files: DataFrame, repo_id: int, language: str | None = None, file_source: str | None = None) -> DataFrame:
    out = files.where(F.col("repo_id") == repo_id)
    if language:
        out = out.where(F.col("language") == language)
    if file_source:
        out = out.where(F.col("file_source") == file_source)
    return out


def by_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is asked for; keys that don't exist are absent."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def search_metadata(files: DataFrame, meta: DataFrame, domain: str | None = None, module: str | None = None, concepts: str | None = None) -> DataFrame:
    """Files by their metadata; all filters None is an error, an empty string filters nothing."""
    if domain is None and module is None and concepts is None:
        raise ValueError("one filter at least")
    out = files.join(meta, "file_id")
    if domain:
        out = out.where(F.col("domain") == domain)
    if module:
        out = out.where(F.col("module") == module)
    if concepts:
        out = out.where(contains_ci(F.col("concepts"), concepts))
    return out


def symbols_by_name(symbols: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    return symbols.where(contains_ci(F.col("name"), pattern)).join(files, "file_id")


def neighbours(edges: DataFrame, keys: DataFrame, direction: str, out: str = "src", into: str = "dst", kinds: list[str] | None = None) -> DataFrame:
    """(key, neighbour) with bag semantics: an edge of several kinds repeats its neighbour. direction: out or in."""
    if direction not in ("out", "in"):
        raise ValueError(f"direction {direction!r}")
    here, there = (out, into) if direction == "out" else (into, out)
    picked = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return picked.select(F.col(here).alias("key"), F.col(there).alias("neighbour")).join(keys.select("key").distinct(), "key", "left_semi")


def symmetric(edges: DataFrame, a: str = "a", b: str = "b", *rest: str) -> DataFrame:
    """Both directions of undirected edges, from one pass over them: one equi-join then serves either endpoint."""
    both = F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst"))))
    return edges.select(both.alias("_e"), *rest).select("_e.src", "_e.dst", *rest)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; the order must be total. Spark limits the groups before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by the order: a hash aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def degree(nodes: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """(node, degree): edges out plus edges in, parallel ones counted, isolated nodes included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    per = ends.groupBy("node").agg(F.count("*").alias("degree"))
    out = nodes.join(per, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.orderBy(F.desc("degree"), "node").limit(k) if k else out


def diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., status): new, removed, changed or unchanged, from one full outer join."""
    o, n = old.select(*key, F.col(value).alias("old"), F.lit(1).alias("in_old")), new.select(*key, F.col(value).alias("new"), F.lit(1).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").select(*key, status.alias("status"))


def file_context(files: DataFrame, symbols: DataFrame, docstrings: DataFrame, comments: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """One row per file with sorted, nested details; the parts are aggregated before they are joined."""
    per = lambda df, col, name: df.groupBy("file_id").agg(F.sort_array(F.collect_set(col)).alias(name))
    parts = [per(symbols, "name", "symbols"), per(docstrings, "id", "docstrings"), per(comments.where("is_rationale"), "id", "rationale"), per(edges, "dst", "imports"), per(commits, "commit_id", "commits")]
    out = files.select("file_id", "path")
    for p in parts:
        out = out.join(p, "file_id", "left")
    names = ("symbols", "docstrings", "rationale", "imports", "commits")
    return out.select("file_id", "path", *[F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c) for c in names])
