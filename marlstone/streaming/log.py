"""The append-only log as a stream: windows with watermarks, sessions, late rows, duplicates, running state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.session import ensure_checkpoint_dir


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder or file of parquet as a stream, with the schema of what lies there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if name.endswith(".parquet") else path)


def as_instant(df: DataFrame, col: str) -> DataFrame:
    """Event time needs an instant; times without a zone are taken as the session's."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def tumbling(df: DataFrame, ts: str, keys: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    return as_instant(df, ts).withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def sliding(df: DataFrame, ts: str, keys: list[str], width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    return as_instant(df, ts).withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    return as_instant(df, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def without_repeats(df: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return as_instant(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def running_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, most, n): the greatest value of each key so far; state is two numbers a key."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most, n = state.get if state.exists else (float("-inf"), 0)
        for p in parts:
            most, n = max(most, float(p[value].max())), n + len(p)
        state.update((most, n))
        yield pd.DataFrame({"key": [k[0]], "most": [most], "n": [n]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, value).groupBy(key).applyInPandasWithState(step, f"key {kind}, most double, n long", "most double, n long", "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream until what is there has been read, and give its rows: all updates, or the last complete result.

    Every batch is written to the checkpoint folder, which all executors share; the driver holds no rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/drain-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows" if mode == "complete" else f"{at}/rows/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows").select(*df.columns)
