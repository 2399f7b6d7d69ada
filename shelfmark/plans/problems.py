"""Queries of the general operators for large catalogues: replay, references, snapshots and skew."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.values import canonical_uuid, digest_text, epoch_ns, event_kind, joined_path, ns_to_timestamp, plain_key
from shelfmark.operators.references import Reference, orphan_report, orphans
from shelfmark.operators.replay import Feed, committed, replay, watermark
from shelfmark.operators.skew import fragment_counts, fragment_join
from shelfmark.operators.snapshots import snapshot_changes
from shelfmark.session import materialise
from shelfmark.sources.tables import table


def object_changes(spark: SparkSession, folder: str, until: Optional[str] = None) -> DataFrame:
    """object_events, with names, keys and ids in one spelling; of a feed until some moment what had arrived by then."""
    kind = event_kind(F.col("event_name"))
    return (
        table(spark, folder, "object_events")
        .filter(F.lit(True) if until is None else F.col("received_at") <= F.lit(until).cast("timestamp"))
        .select(
            kind.alias("kind"), "event_time", "event_id", "bucket",
            plain_key(F.col("object_key")).alias("object_key"), canonical_uuid(F.col("object_id")).alias("object_id"),
        )
    )


def object_feed() -> Feed:
    """How object_changes are to be read: tagging events have numbers, and so count for gaps, but change no state."""
    removes = F.col("kind").startswith("objectremoved")
    return Feed(["bucket", "object_key"], ["event_time", "event_id"], removes, "event_id", effect=F.col("kind").startswith("objectcreated") | removes)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Objects that exist after the last event of the table, which is a whole feed: numbers missing from it hold nothing back."""
    return replay(object_changes(spark, folder), object_feed(), ["object_id"], closed=True)


#: A moment at which the feed is looked at as far as it had arrived then.
SOME_MOMENT = "2025-03-15 00:00:00"


def arrived(spark: SparkSession, folder: str) -> DataFrame:
    """The feed as far as it had arrived at some moment, with the gaps it had then."""
    return object_changes(spark, folder, SOME_MOMENT)


def p1_held(spark: SparkSession, folder: str) -> DataFrame:
    """Events that had arrived at some moment but waited for others."""
    return committed(arrived(spark, folder), object_feed())[1].select("event_id").distinct()


def p1_then(spark: SparkSession, folder: str) -> DataFrame:
    """Objects that were known to exist at some moment."""
    return replay(arrived(spark, folder), object_feed(), ["object_id"])


def p1_watermark(spark: SparkSession, folder: str) -> DataFrame:
    """Up to which event number the feed has arrived without a gap."""
    return watermark(table(spark, folder, "object_events").select("event_id"), "event_id")


def references(spark: SparkSession, folder: str) -> list[Reference]:
    """The references of parts to uploads, and of objects to directories of their bucket."""
    parts, uploads = table(spark, folder, "parts"), table(spark, folder, "multipart_uploads")
    objects, directories = table(spark, folder, "objects"), table(spark, folder, "directories")
    return [
        Reference("parts", parts, parts.id, canonical_uuid(parts.upload_id), parts.uploaded_at, "multipart_uploads", uploads, canonical_uuid(uploads.id), uploads.recorded_at, uploads.deleted_at),
        Reference(
            "objects", objects, objects.id, objects.parent_dir_id, ns_to_timestamp(epoch_ns(objects.created_at_ns)),
            "directories", directories, directories.id, ns_to_timestamp(epoch_ns(directories.recorded_at_ns)), ns_to_timestamp(epoch_ns(directories.deleted_at_ns)),
            objects.bucket, directories.bucket,
        ),
    ]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of parts and objects whose reference has no living target at the end of their month."""
    return orphans(references(spark, folder))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references by table and month."""
    return orphan_report(references(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files added, removed, changed and moved between consecutive listings of a bucket."""
    listing = table(spark, folder, "disk_snapshot").withColumn("key", joined_path(F.col("prefix"), F.col("name")))
    return snapshot_changes(
        listing, "bucket", "snapshot_no", "key",
        ["is_symlink", "symlink_target", "size", "mtime_ns", "inode", "device_id"], ["inode", "device_id", "size"], "loaded_at",
    )


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Changes by bucket, listing and kind."""
    return p4_found(spark, folder).groupBy("bucket", "snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("files"))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(content_hash, size, id, key) of objects whose content is known, the hash as padded base64."""
    return table(spark, folder, "objects").select(digest_text(F.col("checksum_sha256")).alias("content_hash"), "size", "id", "key").filter("content_hash is not null")


def content_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(content_hash, size, n, rows): rows by content, the size most of them carry, and rows of all contents."""
    sizes = fragment_counts(contents(spark, folder), ["content_hash"], ["size"], shard_by=["id", "key"])
    first = F.max(F.when(F.col("size").isNotNull(), F.struct(F.col("n"), (-F.col("size")).alias("less"))))
    groups = sizes.groupBy("content_hash").agg(F.sum("n").alias("n"), first.alias("first"))
    return groups.select("content_hash", (-F.col("first.less")).alias("size"), "n")


def p5_found(spark: SparkSession, folder: str, share: float = 0.03) -> DataFrame:
    """Contents that hold at least that share of all rows with a content hash, with their size.

    A size that two halves of a content's rows carry alike is the smaller one.
    """
    groups = materialise(content_groups(spark, folder))
    total = groups.agg(F.sum("n")).first()[0] or 0
    return groups.filter(F.col("n") >= total * share).select("content_hash", "size")


def p5_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each object row of a content with copies, with the size of its duplicate group."""
    groups = content_groups(spark, folder).filter("n > 1").select("content_hash", F.col("size").alias("group_size"), F.col("n").alias("group_rows"))
    rows = contents(spark, folder).select("content_hash", "id", "key")
    return fragment_join(rows, groups, ["content_hash"]).fillna(-1, ["group_size"])


QUERIES = {f.__name__: f for f in (p1_found, p1_watermark, p1_held, p1_then, p2_found, p2_report, p4_found, p4_report, p5_found, p5_members)}
