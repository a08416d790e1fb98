"""Tables of a data folder as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalog:
    """A folder with one parquet table per name; writing replaces a table through a second folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.root}/{name}.parquet")

    def replace(self, name: str, df: DataFrame) -> None:
        """Write beside the old table, then swap the folders, so a reader sees the old or the new rows."""
        jvm = self.spark.sparkContext._jvm
        path = lambda s: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}.parquet{s}")
        df.write.mode("overwrite").parquet(f"{self.root}/{name}.parquet.new")
        fs = path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path(".old"), True)
        if fs.exists(path("")):
            fs.rename(path(""), path(".old"))
        fs.rename(path(".new"), path(""))
        fs.delete(path(".old"), True)
