"""Queries of stored objects and uploads, and of directories as trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.values import canonical_uuid
from shelfmark.operators import multipart as P
from shelfmark.operators import objects as O
from shelfmark.operators.listing import by_keys
from shelfmark.plans.catalogue import NOW_NS, catalogue, directories
from shelfmark.plans.problems import p1_found
from shelfmark.sources.tables import table


def put_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of documents stored over a catalogue that holds those with a title; titles claim wrong tags for some."""
    docs = table(spark, folder, "documents")
    key = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    uploads = docs.select(
        F.col("source").alias("bucket"), key.alias("key"), F.col("text").cast("binary").alias("content"),
        F.when(F.col("title").isNull(), F.concat(F.lit('"'), F.md5(F.lit("other").cast("binary")), F.lit('"'))).alias("claimed_etag"),
    )
    held = docs.filter("written_at is not null").select(F.col("source").alias("bucket"), key.alias("key"), F.lit("old").alias("id"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("etag"), F.lit(1).alias("scan_level"), F.lit(0).cast("long").alias("created_at_ns"))
    return O.stored(held, O.received(uploads), NOW_NS)


def multipart_complete(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads put together from their parts as first sent."""
    return _completed(spark, folder)[1]


def multipart_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The objects that putting uploads together makes."""
    return _completed(spark, folder)[0].select("bucket", "key", "id", "size", "etag", "content_type").fillna(-1, ["size"])


def _completed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, folder, "parts").withColumn("upload_id", canonical_uuid(F.col("upload_id"))).filter("upload_id is not null")
    asked = parts.groupBy("upload_id", "part_number").agg(F.min_by("etag", F.struct("uploaded_at", "id")).alias("etag")).withColumn("position", F.col("part_number"))
    uploads = table(spark, folder, "multipart_uploads").groupBy("id").agg(F.max_by(F.struct("bucket", "key", F.nullif("content_type", F.lit("")).alias("content_type")), "recorded_at").alias("u")).select("id", "u.*")
    return O.completed(uploads, P.current_parts(parts), asked, NOW_NS)


def cleanup_report(spark: SparkSession, folder: str) -> DataFrame:
    """By bucket: uploads begun before April, their parts and bytes."""
    from shelfmark.plans.catalogue import abandoned_uploads

    return abandoned_uploads(spark, folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("uploads"), F.sum("parts").alias("parts"), F.sum("bytes").alias("bytes"))


def parts_page(spark: SparkSession, folder: str) -> DataFrame:
    """The first parts of the upload with most part numbers, after number 5."""
    parts = P.current_parts(table(spark, folder, "parts").withColumn("upload_id", canonical_uuid(F.col("upload_id"))).filter("upload_id is not null"))
    top = parts.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "upload_id").first()
    return P.parts_page(parts, top.upload_id if top else "", 20, 5).select("upload_id", "part_number", "etag", "size").fillna(-1, ["size"])


def parts_page_more(spark: SparkSession, folder: str) -> DataFrame:
    """The first parts of the upload with most part numbers, and where to go on."""
    parts = P.current_parts(table(spark, folder, "parts").withColumn("upload_id", canonical_uuid(F.col("upload_id"))).filter("upload_id is not null"))
    top = parts.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "upload_id").first()
    return P.parts_page_more(parts, top.upload_id if top else "", 7).select("upload_id", "part_number", "has_more", "next_token").fillna(-1, ["next_token"])


def uploads_page_more(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads after a key and id, and the markers to go on with."""
    uploads = table(spark, folder, "multipart_uploads").select("bucket", "id", "key").distinct()
    mark = uploads.orderBy("key", "id").first()
    found = P.uploads_page_more(uploads, 10, "", mark.key if mark else None, mark.id if mark else None)
    return found.select("bucket", "id", "key", "has_more", F.coalesce("next_token.key_marker", F.lit("")).alias("key_marker"), F.coalesce("next_token.id_marker", F.lit("")).alias("id_marker"))


def head_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of the catalogue that the event feed says exist."""
    files = p1_found(spark, folder).select("bucket", F.col("object_key").alias("key"))
    return O.present(catalogue(spark, folder, "key", "etag", "content_type"), files).select("bucket", "key", "etag", "content_type")


def fetch_by_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of earlier merges' winners, with the merge's time as position."""
    winners = table(spark, folder, "merge_results").select(canonical_uuid(F.col("winner_object_id")).alias("id"), F.unix_micros("merged_at").alias("position")).groupBy("id").agg(F.min("position").alias("position"))
    rows = catalogue(spark, folder, "key")
    wanted = rows.select("bucket", "key", "id").join(winners, "id").select("bucket", "key", "position")
    return by_keys(rows, wanted).select("position", "bucket", "key", "id")


def dir_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return O.recursive_sizes(catalogue(spark, folder, "prefix", "size"))


def dirs_unhashed(spark: SparkSession, folder: str) -> DataFrame:
    return O.unhashed_directories(directories(spark, folder)).select("bucket", "prefix")


def dirs_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Directories with the hashes of their files put in."""
    from shelfmark.operators.duplicates import directory_hashes

    hashes = directory_hashes(catalogue(spark, folder, "prefix", "name", "checksum_sha256", "size")).filter("dir_hash is not null")
    return O.with_stored_hashes(directories(spark, folder), hashes).select("bucket", "prefix", "dir_hash", "file_count", "total_size", "stale").fillna(-1, ["file_count", "total_size"])


def query_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical query strings of listing requests for each directory."""
    raw = F.concat(F.lit("prefix="), F.replace("prefix", F.lit(" "), F.lit("+")), F.lit("&delimiter=%2F&list-type=2&acl"))
    return directories(spark, folder).select("bucket", "prefix", O.canonical_query(raw).alias("query"))


def link_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a link signed when an upload was recorded, good for a day, had expired when it was deleted."""
    rows = table(spark, folder, "multipart_uploads").filter("deleted_at is not null").select("id", "recorded_at", "deleted_at").distinct()
    signed = F.date_format("recorded_at", "yyyyMMdd'T'HHmmss'Z'")
    return rows.select("id", signed.alias("signed"), O.expired(signed, F.lit(86400), F.col("deleted_at")).alias("expired"))


QUERIES = {f.__name__: f for f in (put_objects, multipart_complete, multipart_objects, cleanup_report, parts_page, parts_page_more, uploads_page_more, head_objects, fetch_by_keys, dir_sizes, dirs_unhashed, dirs_stored, query_strings, link_expiry)}
