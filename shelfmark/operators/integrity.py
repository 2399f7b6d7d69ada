"""Stored hashes against those of the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify(catalogue: DataFrame, files: DataFrame, on: Sequence[str] = ("bucket", "key")) -> DataFrame:
    """Each catalogue row with reason: null if it is in order, else what is wrong, in this order.

    files has on, checksum_sha256, mtime_ns and readable. Without a stored hash a row is in order. A
    file that is not there is file_missing, one that can't be read read_error. Another hash is a content
    mismatch, with or without a changed time, null equal to null. An equal hash is in order whatever the time.
    """
    found = files.select(*on, F.struct(F.col("checksum_sha256").alias("hash"), F.col("mtime_ns").alias("mtime_ns"), F.coalesce("readable", F.lit(True)).alias("readable")).alias("_f"))
    moved = ~F.col("file_mtime_ns").eqNullSafe(F.col("_f.mtime_ns"))
    reason = (
        F.when(F.col("checksum_sha256").isNull(), F.lit(None).cast("string"))
        .when(F.col("_f").isNull(), "file_missing")
        .when(~F.col("_f.readable"), "read_error")
        .when(F.col("_f.hash").eqNullSafe(F.col("checksum_sha256")), F.lit(None).cast("string"))
        .when(moved, "content_mismatch_mtime_changed")
        .otherwise("content_mismatch_no_mtime_change")
    )
    return catalogue.join(found, list(on), "left").withColumn("reason", reason).drop("_f")


def rollup(verified: DataFrame, by: Sequence[str] = ("bucket",)) -> DataFrame:
    """Files checked, those in order and their bytes, and discrepancies."""
    fine = F.col("reason").isNull()
    return verified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files_checked"), F.count_if(fine).alias("files_ok"),
        F.coalesce(F.sum(F.when(fine, F.col("size"))), F.lit(0)).alias("bytes_checked"), F.count_if(~fine).alias("discrepancies"),
    )
