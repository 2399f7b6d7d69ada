"""A catalogue brought up to date with a directory tree: found, stat'ed, hashed."""

from __future__ import annotations

import time
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.scalars import key_prefix, with_content_type
from shelfmark.operators.catalogue import classify, enriched, in_scope, next_catalogue, scan_report
from shelfmark.operators.duplicates import directory_hashes
from shelfmark.operators.skew import semi_join
from shelfmark.operators.stats import byte_budget
from shelfmark.session import materialise
from shelfmark.sources.files import FileTree, hashed
from shelfmark.sources.store import Versions
from shelfmark.streaming.background import Background

SCHEMA = (
    "bucket string, id string, prefix string, name string, key string, is_symlink boolean, symlink_target string, size long, file_mtime_ns long, file_ctime_ns long, inode long, device_id long, "
    "etag string, checksum_sha256 string, checksum_sha1 string, checksum_crc32 string, checksum_crc32c string, content_type string, last_modified_ns long, created_at_ns long, scan_level int"
)


def tree(spark: SparkSession, root: str, bucket: str, depth: int = 1) -> DataFrame:
    """Facts of the files under root, written once: all steps of a scan see the same listing."""
    spark.dataSource.register(FileTree)
    return materialise(spark.read.format("file_tree").option("bucket", bucket).option("depth", str(depth)).load(root))


def find(table: Versions, root: str, bucket: str, subtree: Optional[str] = None, now_ns: Optional[int] = None, depth: int = 1) -> dict[str, int]:
    """Level 1: compare the tree with the catalogue and write what changed as the next version; counts by class.

    Rows created since the scan began stay, whether or not their file was listed. A subtree limits what is
    compared; what lies outside stays as it is, and so do unchanged rows.
    """
    spark, now_ns = table.spark, now_ns or time.time_ns()
    if table.current() is None:
        table.commit(spark.createDataFrame([], SCHEMA))
    held, disk = table.read(), tree(spark, root, bucket, depth)
    inside = (F.col("bucket") == bucket) & in_scope(F.col("key"), subtree)
    classes = materialise(classify(held, disk, F.lit(now_ns), inside))
    after = next_catalogue(held.filter(inside), disk, classes.filter("class <> 'unchanged'"), now_ns)
    kinds = with_content_type(after.filter("content_type is null").drop("content_type"), "name")
    after = after.filter("content_type is not null").unionByName(kinds.select(*after.columns))
    gone = classes.filter("class = 'deleted' or old_key is not null").select("bucket", F.coalesce("old_key", "key").alias("key"))
    table.amend(after, gone)
    report = scan_report(classes).drop("bucket").collect()
    return report[0].asDict() if report else dict.fromkeys(("new", "unchanged", "modified", "moved", "deleted"), 0)


def count_in(report: Optional[dict[str, int]], **counts: int) -> None:
    """Add counts to a report, if there is one."""
    if report is not None:
        report.update({k: report.get(k, 0) + n for k, n in counts.items()})


def stat(table: Versions, root: str, bucket: str, depth: int = 1, report: Optional[dict[str, int]] = None) -> int:
    """Level 2: times and sizes of files below it; links go on to level 3, since they have no content. Files without a listing wait.

    How many got theirs. Counted in report: updated, errors (files without a listing), and links among skipped.
    """
    disk = tree(table.spark, root, bucket, depth)
    facts = disk.select("bucket", "key", "is_symlink", "symlink_target", "size", F.col("mtime_ns").alias("file_mtime_ns"), F.col("ctime_ns").alias("file_ctime_ns"), "inode", "device_id")
    held = table.read()
    below = held.filter((F.col("bucket") == bucket) & (F.col("scan_level") < 2)).select("bucket", "key")
    seen = below.join(facts.select("bucket", "key", F.col("is_symlink").alias("_link")), ["bucket", "key"], "left")
    waiting, missing, links = seen.agg(F.count("_link"), F.count_if(F.col("_link").isNull()), F.count_if("_link")).first()
    count_in(report, updated=waiting, errors=missing, skipped=links)
    if waiting:
        after = enriched(held.filter((F.col("bucket") == bucket) & (F.col("scan_level") < 2)), facts, 2).filter(F.col("scan_level") == 2)
        table.amend(after.withColumn("scan_level", F.when(F.col("is_symlink"), 3).otherwise(F.col("scan_level")).cast("int")))
    return waiting


def _digested(table: Versions, rows: DataFrame, root: str, report: Optional[dict[str, int]]) -> None:
    """Hash the files of these rows of the catalogue and write what became of them."""
    found = materialise(hashed(rows.select("bucket", "key"), root))
    times = rows.select("bucket", "key", F.col("file_mtime_ns").alias("_t"))
    whole = found.join(times, ["bucket", "key"]).filter(F.col("checksum_sha256").isNotNull() & F.col("mtime_ns").eqNullSafe(F.col("_t")))
    digests = materialise(whole.select("bucket", "key", "etag", "checksum_sha256", "checksum_sha1", "checksum_crc32", "checksum_crc32c", "size"))
    done, size = digests.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    after = enriched(rows, digests, 3)
    table.amend(after.withColumn("scan_level", F.when(F.col("scan_level") < 3, 1).otherwise(F.col("scan_level")).cast("int")))
    count_in(report, hashed=done, bytes=size, skipped=rows.count() - done)


def digest(table: Versions, root: str, bucket: str, budget: int = 50 << 30, most: int = 10_000, report: Optional[dict[str, int]] = None) -> int:
    """Level 3: digests of the next files, up to a budget of bytes; how many files were dealt with, 0 when there is nothing left to do.

    Files that changed while they were read, or since they were stat'ed, get nothing and go back to level 1,
    and so do those that can't be read, are gone, or became links: no file of a batch comes back in the next.
    Counted in report: files hashed, their bytes, and those skipped, which got nothing.
    """
    held = table.read().filter((F.col("bucket") == bucket) & (F.col("scan_level") == 2))
    batch = materialise(byte_budget(held, 3, budget, most).select("bucket", "key"))
    count = batch.count()
    if count:
        _digested(table, materialise(semi_join(held, batch, ["bucket", "key"])), root, report)
    return count


def digest_all(table: Versions, root: str, bucket: str, budget: int = 50 << 30, most: int = 1_000_000, report: Optional[dict[str, int]] = None) -> int:
    """Level 3 of all files that wait for it, in batches of about a budget of bytes and so many files; how many batches.

    The rows that wait are read and split into batches once. A batch reads its own rows and writes them
    with their digests, so that what a run has done stays done, and the whole costs what waits.
    """
    held = table.read().filter((F.col("bucket") == bucket) & (F.col("scan_level") == 2))
    files, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not files:
        return 0
    batches = max(1, -(-files // most), -(-size // budget))
    planned = materialise(held.withColumn("_batch", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int")), "_batch")
    for n in range(batches):
        _digested(table, planned.filter(F.col("_batch") == n).select(*held.columns), root, report)
    return batches


def rehash_directories(table: Versions, directories: Versions) -> None:
    """Hash the directories in which rows changed since they were hashed last, or all where that is not known; those left without files go.

    The version of the table that directories stand for is noted with them.
    """
    since, now = directories.note(), table.current()
    directories.keys = ("bucket", "prefix")
    hashes = lambda rows: directory_hashes(rows).withColumn("stale", F.col("dir_hash").isNull())
    changed = None if since is None else table.changed_since(since)
    if changed is None:
        directories.commit(hashes(table.read()), note=now)
        return
    places = materialise(changed.select("bucket", key_prefix(F.col("key")).alias("prefix")).filter("prefix <> ''").distinct())
    fresh = materialise(hashes(semi_join(table.read(), places, ["bucket", "prefix"])))
    directories.amend(fresh, places.join(fresh, ["bucket", "prefix"], "left_anti"), note=now)


def refresh(table: Versions, directories: Versions, root: str, bucket: str, level: int = 3, depth: int = 1) -> dict[str, int]:
    """Find, stat and hash, as far as the level asked for, then hash the directories; the counts of all steps made.

    From find new, unchanged, modified, moved and deleted; from stat updated and errors; from digest hashed and bytes; from both skipped.
    """
    report = find(table, root, bucket, depth=depth)
    if level >= 2:
        stat(table, root, bucket, depth, report)
    if level >= 3:
        count_in(report, hashed=0, bytes=0)
        digest_all(table, root, bucket, report=report)
        rehash_directories(table, directories)
    return report


def sync(jobs: Background, table: Versions, directories: Versions, root: str, bucket: str, depth: int = 1) -> str:
    """Find and stat in the background, without hashing: the id of the job, at once. Its result will be the report."""
    return jobs.start(lambda: refresh(table, directories, root, bucket, 2, depth), "sync")
