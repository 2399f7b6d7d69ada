"""Session helpers: a tuned local session, and tables cut loose from their lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, partitions: Optional[int] = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one of our own.

    A cluster names it in the session's settings. Only where that is unset and all runs in one
    process, as in tests, is a temporary folder made and set; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shelfmark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def temporary(spark: SparkSession, path: str) -> str:
    """path, which release() will delete with all below it."""
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    It is for results that several branches of a plan read, or whose rows depend on how they
    were partitioned. The files outlive any executor; they go with release(), or when Python ends.
    """
    spark = df.sparkSession
    path = temporary(spark, f"{shared_folder(spark)}/table-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_written(df: DataFrame) -> bool:
    """Whether the files of a table that materialise wrote are still there: release() has not been called since."""
    return any(path.removeprefix("file:").rstrip("/") in file for file in df.inputFiles() for _, path in _written)


def small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """df, marked for broadcast if it was counted and found to have at most max_rows rows.

    Beyond that it stays as it is, so that Spark shuffles both sides of the join.
    """
    kept = materialise(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


@atexit.register
def release() -> None:
    """Delete all tables written by materialise so far; no DataFrame that reads them can be used any more."""
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
                place = hadoop.Path(path)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session may be gone already
            pass
