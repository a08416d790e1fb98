"""Yes-no judgements as operators: a table of verdicts, a column rule, or a batch function; failures deny."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import answer


def by_table(items: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """`items` with verdict and omitted; a missing key is denied and omitted."""
    v = verdicts.groupBy(key).agg(F.bool_or("verdict").alias("_v"))
    return items.join(v, key, "left").withColumn("omitted", F.col("_v").isNull()).withColumn("verdict", F.coalesce("_v", F.lit(False))).drop("_v")


def by_rule(items: DataFrame, rule: Column) -> DataFrame:
    return items.withColumn("omitted", rule.isNull()).withColumn("verdict", F.coalesce(rule, F.lit(False)))


def by_answers(items: DataFrame, text: str) -> DataFrame:
    """Answers in words, parsed."""
    a = answer(F.col(text))
    return items.withColumn("verdict", F.coalesce(a["verdict"], F.lit(False))).withColumn("omitted", F.coalesce(a["omitted"], F.lit(True)))


def by_function(items: DataFrame, judge: Callable[[pd.DataFrame], list[bool | None]]) -> DataFrame:
    """A batch predicate; an exception or None denies, and `failure` says which exception. Cheap filters belong before this."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            why = None
            try:
                said = list(judge(b))
                if len(said) != len(b):
                    raise ValueError(f"{len(said)} verdicts for {len(b)} rows")
            except Exception as e:
                said, why = [None] * len(b), f"{type(e).__name__}: {e}"
                logging.getLogger(__name__).warning("a batch of %d rows is denied: %s", len(b), why)
            yield b.assign(verdict=[bool(x) for x in said], omitted=[x is None for x in said], failure=why)

    return items.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", verdict boolean, omitted boolean, failure string")


def fits(prompt: Column, system: Column, window: int, max_tokens: int) -> Column:
    """Whether the conservative estimate leaves room for the answer."""
    return F.floor((F.length(prompt) + F.coalesce(F.length(system), F.lit(0))) / 3) <= window - max_tokens


def assert_none_omitted(judged: DataFrame, what: str) -> DataFrame:
    """Fails while running where a verdict is missing."""
    return judged.where(F.assert_true(~F.col("omitted"), F.lit(f"{what}: a verdict is missing")).isNull())


def route(stages: DataFrame, config: DataFrame) -> DataFrame:
    """(stage, model): the stage's own model, else its role's; neither is an error when run."""
    s = stages.join(config.select(F.col("name").alias("stage"), F.col("model").alias("own")), "stage", "left").join(config.select(F.col("name").alias("role"), F.col("model").alias("general")), "role", "left")
    model = F.coalesce("own", "general")
    return s.select("stage", F.coalesce(model, F.raise_error(F.concat(F.lit("no model for "), F.col("stage")))).alias("model"))
