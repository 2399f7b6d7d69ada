"""Tables of a Parquet folder, read with columns pruned and filters pushed down by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name: one Parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
