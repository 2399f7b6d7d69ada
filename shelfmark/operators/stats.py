"""Counts of a catalogue, its state of enrichment, and batches of what is left to do."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import key_name, key_prefix, percent_complete
from shelfmark.operators.duplicates import directory_groups


def bucket_stats(objects: DataFrame, directories: DataFrame) -> DataFrame:
    """By bucket: files, their size, copies that could go, the bytes those take, and groups of equal directories.

    A group of n files takes back its size less a whole n-th of it.
    """
    size = F.coalesce("size", F.lit(0))
    by_content = objects.groupBy("bucket", "checksum_sha256").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s"))
    again = F.col("checksum_sha256").isNotNull() & (F.col("n") > 1)
    spared = F.col("s") - F.floor(F.col("s") / F.col("n")).cast("long")
    files = by_content.groupBy("bucket").agg(
        F.sum("n").alias("files"), F.sum("s").alias("total_size"),
        F.coalesce(F.sum(F.when(again, F.col("n") - 1)), F.lit(0)).alias("duplicate_files"),
        F.coalesce(F.sum(F.when(again, spared)), F.lit(0)).alias("duplicate_size"),
    )
    dirs = directory_groups(directories).groupBy("bucket").agg(F.count(F.lit(1)).alias("duplicate_directories"))
    return files.join(dirs, "bucket", "left").fillna(0, ["duplicate_directories"])


def scan_status(objects: DataFrame, level: int = 3) -> DataFrame:
    """By bucket: files, files that reached the level, those pending, and the percentage; an empty bucket is complete."""
    counted = objects.groupBy("bucket").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("scan_level") >= level).alias("complete"))
    return counted.withColumns({"pending": F.col("files") - F.col("complete"), "percent": percent_complete(F.col("complete"), F.col("files"))})


class ScanPending(Exception):
    """Not all files of a bucket have reached the level an answer needs."""


def require_complete(objects: DataFrame, bucket: str, level: int = 3) -> None:
    """Raise ScanPending unless all files of the bucket reached the level."""
    rows = scan_status(objects.filter(F.col("bucket") == bucket), level).collect()
    if rows and rows[0].pending:
        raise ScanPending(f"{rows[0].pending} of {rows[0].files} files of {bucket} are pending ({rows[0].percent:.1f} % complete)")


def remaining(objects: DataFrame, level: int = 3) -> DataFrame:
    """By bucket: files below the level and their bytes."""
    return objects.filter(F.col("scan_level") < level).groupBy("bucket").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def byte_budget_report(objects: DataFrame, level: int, budget: int, rows: int = 10_000, after: Optional[DataFrame] = None) -> DataFrame:
    """(bucket, files, bytes, last_key, exhausted) of the batches of byte_budget: where the next one goes on, and whether there is one.

    A batch that neither reached the budget nor has as many files as may be is the last of its bucket.
    """
    batch = byte_budget(objects, level, budget, rows, after)
    sums = batch.groupBy("bucket").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max_by("key", F.struct("prefix", "name")).alias("last_key"))
    return sums.withColumn("exhausted", (F.col("bytes") < budget) & (F.col("files") < rows))


def byte_budget(objects: DataFrame, level: int, budget: int, rows: int = 10_000, after: Optional[DataFrame] = None) -> DataFrame:
    """By bucket the next files below the level in listing order, until their sizes reach the budget: at least one, at most `rows`.

    after has (bucket, last_key): the files of a bucket up to that key are left out.

    Each bucket is cut into slices by a hash of the key, of which the first `rows` stay; a bucket with
    most files is many slices. Running sums then see so many rows of a bucket as there are slices times
    that, whatever its size.
    """
    order = Window.partitionBy("bucket").orderBy("prefix", "name")
    if after is not None:
        reached = after.select("bucket", F.struct(key_prefix(F.col("last_key")).alias("prefix"), key_name(F.col("last_key")).alias("name")).alias("_reached"))
        objects = objects.join(F.broadcast(reached), "bucket", "left").filter(F.col("_reached").isNull() | (F.struct("prefix", "name") > F.col("_reached")))  # one row a bucket
    sliced = objects.filter(F.col("scan_level") < level).select("bucket", "prefix", "name", "key", F.coalesce("size", F.lit(0)).alias("size"), F.pmod(F.xxhash64("key"), F.lit(64)).alias("slice"))
    local = Window.partitionBy("bucket", "slice").orderBy("prefix", "name")
    kept = sliced.withColumn("turn", F.row_number().over(local)).filter(F.col("turn") <= rows).drop("slice")
    first = kept.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= rows)
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("running", running).filter((F.col("running") - F.col("size") < budget) | (F.col("turn") == 1))


def throughput(samples: DataFrame, keys: list[str], order: str, rate: str, alpha: float = 0.3) -> DataFrame:
    """The exponentially weighted mean of a rate by keys, the first sample as seed."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(rate).alias("r")))), lambda s: s["r"])
    smooth = F.aggregate(F.slice(F.col("_rates"), 2, 1 << 30), F.get(F.col("_rates"), F.lit(0)), lambda acc, r: r * alpha + acc * (1 - alpha))
    return samples.filter(F.col(rate).isNotNull()).groupBy(*keys).agg(ordered.alias("_rates")).withColumn("rate", smooth).drop("_rates")
