"""Putting a context package together under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.numbering import numbered


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def conservative_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 3).cast("long")


def framing_tokens(path: Column, language: Column, level: Column, has_metadata: Column) -> Column:
    """What the frame of a file costs: its head line, code tags, and a line of metadata where there is one."""
    head = F.concat(F.lit("## "), path, F.lit(" ["), language, F.lit("] ("), level, F.lit(")\n"))
    tags = F.concat(F.lit('<code lang="'), language, F.lit('">\n</code>\n'))
    # Fixed value: the line of metadata is reckoned with 29 characters.
    return F.floor((F.length(head) + F.length(tags) + F.when(has_metadata, 29).otherwise(0)) / 4).cast("long")


def final_order(df: DataFrame, level: str = "level", tier: str = "tier", key: str = "file_id") -> DataFrame:
    """Files as a package shows them: primary, supporting, type_context, then by tier; `place` is the number in that order."""
    rank = F.when(F.col(level) == "primary", 0).when(F.col(level) == "supporting", 1).when(F.col(level) == "type_context", 2)
    ranked = df.withColumn("_rank", rank).where("_rank is not null")
    return numbered(ranked, "_rank", tier, key).withColumnRenamed("num", "place").drop("_rank")


def effective_budget(window: Column, reserved: Column) -> Column:
    return F.floor((window - reserved) * 0.9).cast("long")


def first_fit(df: DataFrame, group: str, order: list[str], item: str, size: str, budget: Column) -> DataFrame:
    """(group, item, kept): in order, what doesn't fit is skipped and later ones are still tried.

    A running sum would be wrong; the fold goes over one array per group, which holds the group's items and sizes only.
    """
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(size).alias("_size"), F.col(item).alias("_item")))).alias("rows"), F.max(budget).cast("long").alias("budget"))
    start = F.struct(F.col("budget").alias("left"), F.array().cast(f"array<{df.schema[item].dataType.simpleString()}>").alias("kept"))
    fold = F.aggregate(
        "rows", start,
        lambda acc, x: F.when(x["_size"] <= acc["left"], F.struct((acc["left"] - x["_size"]).alias("left"), F.concat(acc["kept"], F.array(x["_item"])).alias("kept"))).otherwise(acc),
    )
    done = rows.select(group, fold.alias("f"), "rows")
    return done.select(group, F.explode("rows").alias("r"), F.col("f.kept").alias("kept")).select(group, F.col("r._item").alias(item), F.array_contains("kept", F.col("r._item")).alias("kept"))


def drop_levels(df: DataFrame, group: str, level: str, size: str, budget: int, order: tuple[str, ...] = ("type_context", "supporting", "primary")) -> DataFrame:
    """Whole levels are dropped, the least important first, until the rest fits; rows of the levels that stay."""
    per = df.groupBy(group).agg(F.sum(size).alias("_total"), *[F.coalesce(F.sum(F.when(F.col(level) == x, F.col(size))), F.lit(0)).alias(f"_{x}") for x in order])
    left, cut = F.col("_total"), F.lit(0)
    for k, x in enumerate(order):
        cut = F.when(left > budget, F.lit(k + 1)).otherwise(cut)
        left = left - F.col(f"_{x}")
    rank = F.lit(0)
    for k, x in enumerate(order):
        rank = F.when(F.col(level) == x, F.lit(k + 1)).otherwise(rank)
    return df.join(per.select(group, cut.alias("_cut")), group).where(rank > F.col("_cut")).drop("_cut")


def detail_level(symbols: DataFrame) -> DataFrame:
    """(file_id, level, names): the best level among a file's symbols, excluded ones aside."""
    rank = F.when(F.col("level") == "primary", 0).when(F.col("level") == "supporting", 1).when(F.col("level") == "type_context", 2)
    out = symbols.withColumn("rank", rank).where("rank is not null").groupBy("file_id").agg(F.min("rank").alias("rank"), F.sort_array(F.collect_set("name")).alias("names"))
    return out.select("file_id", F.element_at(F.array(F.lit("primary"), F.lit("supporting"), F.lit("type_context")), F.col("rank") + 1).alias("level"), "names")


def slices(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, rendered): the lines of each symbol in order, `...` where lines between are left out."""
    lines = texts.select("file_id", F.split("content", "\r?\n").alias("lines"))
    rows = symbols.join(lines, "file_id").select("file_id", "start_line", "end_line", F.array_join(F.slice("lines", F.col("start_line").cast("int"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n").alias("text"))
    per = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "text"))).alias("parts"))
    join = F.aggregate(
        "parts", F.struct(F.lit(0).cast("long").alias("end"), F.lit("").alias("text")),
        lambda acc, p: F.struct(
            F.greatest(acc["end"], p["end_line"]).cast("long").alias("end"),
            F.concat(acc["text"], F.when(acc["end"] == 0, F.when(p["start_line"] > 1, "...\n").otherwise("")).when(p["start_line"] > acc["end"] + 1, "\n...\n").otherwise("\n"), p["text"]).alias("text"),
        ), lambda acc: acc["text"],
    )
    return per.select("file_id", join.alias("rendered"))
