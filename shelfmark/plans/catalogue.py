"""Queries of a catalogue: duplicates, directories, listings, statistics, scans, uploads, tags and events.

Integers that are unknown, such as sizes of files not yet stat'ed, are -1 in results.
"""

from __future__ import annotations

from datetime import datetime
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import digests as D
from shelfmark.functions import scalars as S
from shelfmark.functions.values import canonical_uuid, digest_text, joined_path, plain_key
from shelfmark.operators import catalogue as C
from shelfmark.operators import duplicates as U
from shelfmark.operators import integrity as I
from shelfmark.operators import listing as L
from shelfmark.operators import matching as M
from shelfmark.operators import multipart as P
from shelfmark.operators import stats as T
from shelfmark.operators import tags as G
from shelfmark.plans.problems import object_changes, p1_found
from shelfmark.session import is_written, materialise, small
from shelfmark.sources.tables import table

#: When changes made by queries are said to happen.
NOW_NS = 1_760_000_000_000_000_000


#: Where an object is.
PLACE = ("prefix", "name", "key")


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """objects, each once, with SHA-256 digests in one spelling: written once for all queries of a session, in ranges of bucket and listing order.

    A redelivered row repeats the whole of the one before. Since the files are sorted, filters of bucket,
    prefix or key skip most of them, and no query shuffles rows to tell repeated ones apart. A table whose
    files change is written anew.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(f"{folder}/objects.parquet")
    fs = place.getFileSystem(conf)
    state = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(place))
    key = (spark.sparkContext.applicationId, folder, tuple(state))
    if key not in _KEPT or not is_written(_KEPT[key]):
        rows = table(spark, folder, "objects").dropDuplicates(["id"]).withColumn("checksum_sha256", digest_text(F.col("checksum_sha256")))
        order = [c for c in ("bucket", "prefix", "name") if c in rows.columns]
        _KEPT[key] = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    return _KEPT[key]


def catalogue(spark: SparkSession, folder: str, *columns: str, where: Optional[Column] = None) -> DataFrame:
    """objects, each once: bucket, id and the columns asked for, or all. where filters the stored columns, in the scan."""
    rows = kept(spark, folder)
    rows = rows if where is None else rows.filter(where)
    return rows.select(*dict.fromkeys(["bucket", "id", *columns])) if columns else rows


def directories(spark: SparkSession, folder: str) -> DataFrame:
    """directories that live, each once."""
    return table(spark, folder, "directories").filter("deleted_at_ns is null").dropDuplicates(["bucket", "prefix"])


def listings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The last two listings of each bucket in disk_snapshot, each file once: what a catalogue holds, and what is on disk."""
    rows = table(spark, folder, "disk_snapshot").withColumn("key", joined_path(F.col("prefix"), F.col("name")))
    order = rows.groupBy("bucket").agg(F.array_sort(F.collect_set("snapshot_no")).alias("all"))
    last = order.select("bucket", F.element_at("all", -1).alias("disk_no"), F.get("all", F.size("all") - 2).alias("old_no"))
    once = rows.join(small(last), "bucket")
    cols = ["bucket", "key", "is_symlink", "size", "mtime_ns", "inode", "device_id"]
    return (
        once.filter(F.col("snapshot_no") == F.col("old_no")).select(*cols).dropDuplicates(["bucket", "key"]),
        once.filter(F.col("snapshot_no") == F.col("disk_no")).select(*cols).dropDuplicates(["bucket", "key"]),
    )


# Duplicates.


def dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    return U.groups(catalogue(spark, folder, "checksum_sha256", "size"))


def dup_members(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalogue(spark, folder, "key", "checksum_sha256", "size")
    return U.members(rows, U.groups(rows)).select("bucket", "checksum_sha256", "id", "key")


def dup_first_size(spark: SparkSession, folder: str) -> DataFrame:
    return U.first_sizes(catalogue(spark, folder, "prefix", "name", "checksum_sha256", "size")).fillna(-1, ["size"])


def dup_page(spark: SparkSession, folder: str) -> DataFrame:
    return U.groups_page(U.cross_bucket_groups(catalogue(spark, folder, "checksum_sha256", "size")), 100)


def dup_page2(spark: SparkSession, folder: str) -> DataFrame:
    found = U.cross_bucket_groups(catalogue(spark, folder, "checksum_sha256", "size"))
    return U.groups_page(found, 100, U.encode_group_token(1_000_000, "0"))


def dup_page_more(spark: SparkSession, folder: str) -> DataFrame:
    return U.groups_page_more(U.cross_bucket_groups(catalogue(spark, folder, "checksum_sha256", "size")), 50, U.encode_group_token(1_000_000, "0")).fillna("", ["next_token"])


def dup_cross_members(spark: SparkSession, folder: str) -> DataFrame:
    return U.cross_bucket_report(catalogue(spark, folder, "key", "checksum_sha256", "size"), 100)


def dup_partial(spark: SparkSession, folder: str) -> DataFrame:
    return U.groups_so_far(catalogue(spark, folder, "checksum_sha256", "size", "scan_level"), allow_partial=True)


def dup_key_contains(spark: SparkSession, folder: str) -> DataFrame:
    return U.groups(catalogue(spark, folder, "key", "checksum_sha256", "size"), key_contains="REPORT%.")


def dup_key_depth(spark: SparkSession, folder: str) -> DataFrame:
    return U.groups(catalogue(spark, folder, "key", "checksum_sha256", "size"), key_contains="scan_", max_depth=3)


def dup_cross_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return U.cross_bucket_groups(catalogue(spark, folder, "checksum_sha256", "size"))


def bucket_stats(spark: SparkSession, folder: str) -> DataFrame:
    return T.bucket_stats(catalogue(spark, folder, "checksum_sha256", "size"), directories(spark, folder))


# Directories. Their hashes are made from the files here, since those of the table are invented.


def hashed_directories(spark: SparkSession, folder: str) -> DataFrame:
    """Directory hashes of the files of lineitem, one directory an order: names repeat there, so equal directories exist."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("content"))
    files = lines.select(
        F.lit("orders").alias("bucket"), F.concat(F.lit("o"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("/")).alias("prefix"),
        F.concat(F.lit("line_"), F.col("l_linenumber").cast("string"), F.lit(".txt")).alias("name"),
        F.octet_length("content").cast("long").alias("size"), D.sha256_base64(F.col("content").cast("binary")).alias("checksum_sha256"),
    )
    return U.directory_hashes(files).withColumn("stale", F.lit(False))


def dir_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return U.directory_hashes(catalogue(spark, folder, "prefix", "name", "checksum_sha256", "size"))


def dup_dirs(spark: SparkSession, folder: str) -> DataFrame:
    return U.directory_groups(hashed_directories(spark, folder))


def dup_dirs_members(spark: SparkSession, folder: str) -> DataFrame:
    found = hashed_directories(spark, folder)
    return U.directory_members(found, U.directory_groups(found)).select("bucket", "prefix", "dir_hash")


def dup_dirs_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return U.directory_groups(hashed_directories(spark, folder), prefix="O0000_", max_depth=1)


def dup_dirs_min_files(spark: SparkSession, folder: str) -> DataFrame:
    return U.directory_groups(hashed_directories(spark, folder), min_files=3)


def dup_dirs_page(spark: SparkSession, folder: str) -> DataFrame:
    return U.directories_page(U.directory_groups(hashed_directories(spark, folder), within=[]), 100, "4")


def dup_dirs_page_more(spark: SparkSession, folder: str) -> DataFrame:
    return U.directories_page_more(U.directory_groups(hashed_directories(spark, folder), within=[]), 100, U.encode_directory_token("4")).fillna("", ["next_token"])


def compare_dirs(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalogue(spark, folder, "key", "checksum_sha256", where=F.col("key").startswith("archive/") | F.col("key").startswith("exports/")).withColumn("path", F.regexp_replace("key", "^[^/]*/", ""))
    side = lambda d: rows.filter(F.col("key").startswith(d)).groupBy("bucket", "path").agg(F.min("checksum_sha256").alias("checksum_sha256"))
    return U.compare(side("archive/"), side("exports/"), ["bucket", "path"])


def compare_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Names of files in one bucket against those in another."""
    rows = catalogue(spark, folder, "name", "checksum_sha256", where=F.col("bucket").isin("field-notes", "scan-archive"))
    side = lambda b: rows.filter(F.col("bucket") == b).groupBy("name").agg(F.min("checksum_sha256").alias("checksum_sha256"))
    return U.compare(side("field-notes"), side("scan-archive"), ["name"])


def compare_buckets_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one bucket against those of another, by their path below the root; compare_buckets has one row for all files of a name."""
    rows = catalogue(spark, folder, "key", "checksum_sha256", where=F.col("bucket").isin("field-notes", "scan-archive") & F.col("key").isNotNull())
    side = lambda b: rows.filter(F.col("bucket") == b).groupBy("key").agg(F.min("checksum_sha256").alias("checksum_sha256"))
    return U.compare(side("field-notes"), side("scan-archive"), ["key"])


def compare_summary(spark: SparkSession, folder: str) -> DataFrame:
    return U.compare_summary(compare_dirs(spark, folder), ["bucket"])


# Listings.


def list_flat(spark: SparkSession, folder: str) -> DataFrame:
    return L.page(catalogue(spark, folder, *PLACE), 1000).select("bucket", "id", "key")


def list_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return L.page(catalogue(spark, folder, *PLACE, where=L.under(F.col("key"), "archive/de")), 1000, "archive/de").select("bucket", "id", "key")


def list_page(spark: SparkSession, folder: str) -> DataFrame:
    return L.page(catalogue(spark, folder, *PLACE, where=L.beyond(("devices/h", "m"))), 1000, "", ("devices/h", "m")).select("bucket", "id", "key")


def list_keys(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue(spark, folder, "key", where=L.under(F.col("key"), "staging/")).select("bucket", "key")


def list_delimiter(spark: SparkSession, folder: str) -> DataFrame:
    return L.entries(catalogue(spark, folder, "key", "size")).fillna(-1, ["size"])


def list_delimiter_below(spark: SparkSession, folder: str) -> DataFrame:
    return L.entries(catalogue(spark, folder, "key", "size", where=L.under(F.col("key"), "archive/")), "archive/", "-0").fillna(-1, ["size"])


def list_entries_page(spark: SparkSession, folder: str) -> DataFrame:
    return L.entries_page(catalogue(spark, folder, "key", "size", where=L.under(F.col("key"), "archive/")), 50, "archive/", "/", L.encode_token("archive/delta/")).drop("next_token").fillna(-1, ["size"])


def list_bucket_delimiter(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of each bucket's own root; list_delimiter makes equal ones of all buckets one."""
    return L.entries(catalogue(spark, folder, "key", "size"), within=["bucket"]).fillna(-1, ["size"])


def list_bucket_delimiter_below(spark: SparkSession, folder: str) -> DataFrame:
    return L.entries(catalogue(spark, folder, "key", "size", where=L.under(F.col("key"), "archive/")), "archive/", "-0", ["bucket"]).fillna(-1, ["size"])


def list_bucket_entries_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalogue(spark, folder, "key", "size", where=L.under(F.col("key"), "archive/"))
    return L.entries_page(rows, 50, "archive/", "/", L.encode_token("archive/delta/", "field-notes"), ["bucket"]).drop("next_token").fillna(-1, ["size"])


def list_bucket_entries_more(spark: SparkSession, folder: str) -> DataFrame:
    """The first entries of all buckets below a prefix, and the token to go on with."""
    rows = catalogue(spark, folder, "key", "size", where=L.under(F.col("key"), "archive/"))
    return L.entries_page(rows, 20, "archive/", "/", None, ["bucket"]).fillna(-1, ["size"]).fillna("", ["next_token"])


def list_page_more(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalogue(spark, folder, *PLACE, where=(F.col("bucket") == "field-notes") & L.beyond(("archive/", "")))
    return L.page_more(rows, 50, "", L.encode_token("archive/")).select("bucket", "id", "key", "has_more", "next_token").fillna("", ["next_token"])


def list_by_parent(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue(spark, folder, "prefix", "name").groupBy("bucket", "prefix").agg(F.count(F.lit(1)).alias("files"), F.min("name").alias("first_name"))


def list_root(spark: SparkSession, folder: str) -> DataFrame:
    return L.children(catalogue(spark, folder, *PLACE, where=F.col("prefix") == ""), "").select("bucket", "id", "key")


def list_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "objects").select("bucket").distinct()


def get_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of the catalogue that the event feed says exist, by key."""
    return p1_found(spark, folder).select("bucket", F.col("object_key").alias("key")).join(catalogue(spark, folder, "key", "size", "scan_level"), ["bucket", "key"]).select("bucket", "key", "id", "size", "scan_level").fillna(-1, ["size"])


def get_object(spark: SparkSession, folder: str) -> DataFrame:
    """The object whose key comes first in its bucket, looked up by key, by id and by the identity of its file."""
    rows = table(spark, folder, "objects").select("bucket", "id", "prefix", "name", "key", "inode", "device_id")
    first = rows.filter("key is not null and inode is not null and device_id is not null").orderBy("bucket", "key").first()
    if first is None:
        return rows.select(F.lit("key").alias("by"), "bucket", "id", "key").limit(0)
    found = {"key": L.get(rows, first.bucket, first.key), "id": L.get_by_id(rows, first.id), "identity": L.get_by_identity(rows, first.bucket, first.inode, first.device_id)}
    each = [df.select(F.lit(by).alias("by"), "bucket", "id", "key").distinct() for by, df in found.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


def get_by_inode(spark: SparkSession, folder: str) -> DataFrame:
    """The first object of each file identity."""
    known = catalogue(spark, folder, "key", "inode", "device_id").filter("inode is not null and device_id is not null")
    return known.groupBy("bucket", "inode", "device_id").agg(F.min("key").alias("key"))


# Statistics and batches.


def count_objects(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue(spark, folder, "scan_level").agg(F.count(F.lit(1)).alias("objects"))


def scan_status(spark: SparkSession, folder: str) -> DataFrame:
    return T.scan_status(catalogue(spark, folder, "scan_level"))


def remaining(spark: SparkSession, folder: str) -> DataFrame:
    return T.remaining(catalogue(spark, folder, "scan_level", "size", where=F.col("scan_level") < 3))


def at_level_3(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue(spark, folder, "key", "scan_level", where=F.col("scan_level") >= 3).select("bucket", "id", "key")


def below_level_page(spark: SparkSession, folder: str) -> DataFrame:
    return L.page(catalogue(spark, folder, *PLACE, "scan_level", where=F.col("scan_level") < 3), 1000, after=("devices/", "")).select("bucket", "id", "key")


def byte_budget(spark: SparkSession, folder: str) -> DataFrame:
    return T.byte_budget(catalogue(spark, folder, *PLACE, "size", "scan_level", where=F.col("scan_level") < 3), 3, 50 << 20).select("bucket", "key", "size", "running")


def byte_budget_next(spark: SparkSession, folder: str) -> DataFrame:
    """Of each bucket the batch after the first one."""
    rows = catalogue(spark, folder, *PLACE, "size", "scan_level", where=F.col("scan_level") < 3)
    first = materialise(T.byte_budget_report(rows, 3, 50 << 20, 100))
    return T.byte_budget_report(rows, 3, 50 << 20, 100, first)


def upload_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """The smoothed size of the parts of each upload, in part order, and the budget it would give."""
    parts = P.current_parts(table(spark, folder, "parts").withColumn("upload_id", canonical_uuid(F.col("upload_id"))).filter("upload_id is not null"))
    rates = T.throughput(parts.withColumn("rate_in", F.col("size").cast("double")), ["upload_id"], "part_number", "rate_in")
    return rates.select("upload_id", F.round("rate", 3).alias("rate"), S.byte_budget_for(F.col("rate")).alias("budget"), S.readers_for(F.col("rate")).alias("readers"))


# Scans and changes.


def l1_classify(spark: SparkSession, folder: str) -> DataFrame:
    return C.classify(*listings(spark, folder))


def l1_moves(spark: SparkSession, folder: str) -> DataFrame:
    return l1_classify(spark, folder).filter("class = 'moved'").select("bucket", "old_key", "key")


def l1_stale(spark: SparkSession, folder: str) -> DataFrame:
    return l1_classify(spark, folder).filter("class = 'deleted'").select("bucket", "key")


def l1_report(spark: SparkSession, folder: str) -> DataFrame:
    return C.scan_report(l1_classify(spark, folder))


def l1_next(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue after the last listing."""
    old, disk = listings(spark, folder)
    held = old.withColumns({"id": F.sha2(F.concat_ws("/", "bucket", "key"), 256), "scan_level": F.lit(2), "created_at_ns": F.lit(0).cast("long"), "last_modified_ns": F.lit(0).cast("long")})
    after = C.next_catalogue(held, disk, C.classify(held, disk), NOW_NS)
    return after.select("bucket", "key", "id", "size", "inode", "scan_level", "last_modified_ns").fillna(-1, ["size", "inode"])


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """What the event feed wrote last to each key."""
    events = table(spark, folder, "object_events").select("event_id", "event_time", "size", "etag")
    made = object_changes(spark, folder).filter(F.col("kind").startswith("objectcreated")).select("event_id", "bucket", F.col("object_key").alias("key"), F.col("object_id").alias("id")).dropDuplicates(["event_id"])
    return made.join(events.dropDuplicates(["event_id"]), "event_id").withColumn("created_at_ns", F.unix_micros("event_time") * 1000)


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    old = catalogue(spark, folder, "key", "created_at_ns", "size", "etag").select("bucket", "key", "id", "created_at_ns", "size", "etag")
    return C.upsert(old, _written(spark, folder), ["bucket", "key"], ["event_time", "event_id"]).fillna(-1, ["size"])


def delete_anti(spark: SparkSession, folder: str) -> DataFrame:
    gone = object_changes(spark, folder).filter(F.col("kind").startswith("objectremoved")).select("bucket", F.col("object_key").alias("key"))
    return C.deleted(catalogue(spark, folder, "key"), gone).select("bucket", "key", "id")


def bulk_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = object_changes(spark, folder).filter(F.col("kind").startswith("objectremoved")).select("bucket", F.col("object_key").alias("key"))
    return C.bulk_delete(catalogue(spark, folder, "key"), gone)


def rename_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Files in directories called tmp moved to their parent, as far as the names there are free."""
    rows = catalogue(spark, folder, *PLACE, "last_modified_ns")
    moves = rows.filter(F.col("prefix").contains("/tmp/")).select("bucket", F.col("key").alias("old_key"), F.regexp_replace("key", "/tmp/", "/").alias("new_key"))
    return C.renamed(rows, moves, NOW_NS).select("bucket", "key", "prefix", "name", "id", "last_modified_ns")


def rename_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The moves of l1_moves asked of the catalogue that the event feed leaves, and what would come of each."""
    there = p1_found(spark, folder).select("bucket", F.col("object_key").alias("key"))
    moves = object_changes(spark, folder).filter(F.col("kind") == "objectcreated:copy").select("bucket", F.col("object_key").alias("old_key"), F.regexp_replace("object_key", r"\.tmp$", ".part").alias("new_key"))
    return C.renames(there, moves)


def enrich_monotone(spark: SparkSession, folder: str) -> DataFrame:
    last = _written(spark, folder).groupBy("bucket", "key").agg(F.max_by(F.struct("size", "etag"), F.struct("event_time", "event_id")).alias("u"))
    return C.enriched(catalogue(spark, folder, "key", "size", "etag", "scan_level"), last.select("bucket", "key", "u.*"), 2).select("bucket", "key", "size", "etag", "scan_level").fillna(-1, ["size"])


def reset_level(spark: SparkSession, folder: str) -> DataFrame:
    return C.reset(catalogue(spark, folder, "key", "scan_level"), _written(spark, folder), 1).select("bucket", "key", "scan_level")


def copy_apply(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalogue(spark, folder, *PLACE, "size", "checksum_sha256", "created_at_ns", "last_modified_ns", where=F.col("prefix").startswith("shared/"))
    asked = rows.filter(F.col("prefix").startswith("shared/")).select("bucket", "key", F.lit("copies").alias("to_bucket"), F.concat("bucket", F.lit("/"), "key").alias("to_key"))
    return C.copies(rows, asked, NOW_NS).select("bucket", "key", "prefix", "name", "id", "size", "checksum_sha256").fillna(-1, ["size"])


def merge_plan(spark: SparkSession, folder: str) -> DataFrame:
    """For each earlier merge, all files of the winner's directory put up as losers; a winner that is gone has none."""
    rows = catalogue(spark, folder, "prefix", "checksum_sha256")
    winners = table(spark, folder, "merge_results").select(canonical_uuid(F.col("winner_object_id")).alias("winner_id")).distinct()
    mine = winners.join(rows.select(F.col("id").alias("winner_id"), "bucket", "prefix"), "winner_id", "left")
    others = rows.select("bucket", "prefix", F.col("id").alias("loser_id"))
    asked = mine.join(others, ["bucket", "prefix"], "left").select("winner_id", F.coalesce("loser_id", F.lit("none")).alias("loser_id"))
    return C.merge_plan(rows, asked)


def stale_dirs(spark: SparkSession, folder: str) -> DataFrame:
    """Directories in which the last listing has other names than the one before."""
    hashed = lambda d: d.select("bucket", S.key_prefix(F.col("key")).alias("prefix"), S.key_name(F.col("key")).alias("name"), F.sha2(F.concat_ws("/", "size", "mtime_ns"), 256).alias("checksum_sha256"))
    old, disk = listings(spark, folder)
    return C.stale_directories(hashed(old), hashed(disk))


# Integrity, on documents as files: by number some are missing on disk, some are changed.


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("bucket"), "lang", F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"))
    ten, odd = F.pmod("doc_id", F.lit(10)), F.pmod(F.floor(F.col("doc_id") / 10), F.lit(2))
    key = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    held = docs.select("bucket", key.alias("key"), "size", F.when(ten != 9, D.sha256_base64(F.col("content"))).alias("checksum_sha256"), (F.col("doc_id") * 1000).alias("file_mtime_ns"))
    changed = F.when(ten == 3, F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content"))
    disk = docs.filter(ten != 1).select("bucket", key.alias("key"), D.sha256_base64(changed).alias("checksum_sha256"), (F.col("doc_id") * 1000 + F.when(ten == 3, odd).otherwise(0)).alias("mtime_ns"), (ten != 5).alias("readable"))
    return held, disk


def integrity_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return I.verify(*_files(spark, folder)).filter("reason is not null").select("bucket", "key", "reason")


def integrity_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return I.rollup(I.verify(*_files(spark, folder)))


# Tags, uploads and events.


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue(spark, folder).select("bucket", F.col("id").alias("object_id"), F.explode("metadata").alias("key", "value"))


def tags_get(spark: SparkSession, folder: str) -> DataFrame:
    return G.tags_of(catalogue(spark, folder, "key"), _tags(spark, folder))


def tags_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and languages of documents as tags: those too long, and all whose object is missing."""
    docs = table(spark, folder, "documents")
    tags = docs.select(F.col("source").alias("bucket"), F.col("doc_id").cast("string").alias("object_id"), F.coalesce("title", F.lit("none")).alias("key"), F.col("text").alias("value"))
    there = docs.filter("lang is not null").select(F.col("source").alias("bucket"), F.col("doc_id").cast("string").alias("id"))
    return G.tag_problems(there, tags)


def multipart_etag(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "parts").withColumn("upload_id", canonical_uuid(F.col("upload_id"))).filter("upload_id is not null")
    return P.composite_etags(P.current_parts(parts).withColumn("position", F.col("part_number")))


def multipart_check(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as first sent, asked for after later ones came: which of them still hold."""
    parts = table(spark, folder, "parts").withColumn("upload_id", canonical_uuid(F.col("upload_id"))).filter("upload_id is not null")
    first = parts.groupBy("upload_id", "part_number").agg(F.min_by("etag", F.struct("uploaded_at", "id")).alias("etag"))
    return P.check_request(first, P.current_parts(parts)).select("upload_id", "part_number", "etag", "valid")


def multipart_list(spark: SparkSession, folder: str) -> DataFrame:
    uploads = table(spark, folder, "multipart_uploads").select("bucket", "id", "key").distinct()
    return P.uploads_page(uploads, 100, "TEAMS/", "teams/b")


def abandoned_uploads(spark: SparkSession, folder: str) -> DataFrame:
    parts = P.current_parts(table(spark, folder, "parts").withColumn("upload_id", canonical_uuid(F.col("upload_id"))).filter("upload_id is not null"))
    return P.abandoned(table(spark, folder, "multipart_uploads").withColumn("id", canonical_uuid(F.col("id"))), parts, datetime(2025, 4, 1))


WEBHOOKS = [
    ("field-notes", "w1", "http://a", ["s3:ObjectCreated:*"], ("archive/", None)),
    ("field-notes", "w2", "http://b", ["s3:ObjectRemoved:Delete", "s3:ObjectCreated:Put"], (None, ".jpg")),
    ("scan-archive", "w3", "http://c", ["s3:*"], None),
    ("studio-raw", "w4", "http://d", ["s3:ObjectCreated:P", "s3:ObjectTagging:*"], ("teams/", ".json")),
]


def webhook_match(spark: SparkSession, folder: str) -> DataFrame:
    hooks = spark.createDataFrame(WEBHOOKS, "bucket string, id string, url string, events array<string>, filter struct<prefix:string,suffix:string>")
    events = table(spark, folder, "object_events").select("event_id", "bucket", "event_name", plain_key(F.col("object_key")).alias("object_key"))
    return M.deliveries(events, hooks).select("event_id", "webhook_id", "object_key")


CORS = [
    ("scan", 1, ["https://*.example.com"], ["GET"]), ("scan", 2, ["*"], ["head"]), ("scan", 3, ["http://plain"], ["*"]), ("view", 1, ["http://plain"], ["PUT", "get"]),
]


def cors_match(spark: SparkSession, folder: str) -> DataFrame:
    """Requests made of events: which rule allows each."""
    rules = spark.createDataFrame(CORS, "bucket string, position int, allowed_origins array<string>, allowed_methods array<string>")
    asked = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "view").otherwise("scan").alias("bucket"),
        F.when(F.col("value") > 50, F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com"))).otherwise("http://plain").alias("origin"),
        F.when(F.col("event_type") == "click", "GET").when(F.col("event_type") == "error", "HEAD").otherwise("PUT").alias("method"),
    )
    return M.first_rule(asked, rules).select("event_id", "rule").fillna(-1, ["rule"])


def conditional_get(spark: SparkSession, folder: str) -> DataFrame:
    """Each write of the event feed asked for again under the tag and time of the catalogue's row."""
    rows = catalogue(spark, folder, "key", "etag", "last_modified_ns").select("bucket", "key", F.col("etag").alias("held"), F.timestamp_micros(F.floor(F.col("last_modified_ns").cast("decimal(20,0)") / 1000).cast("long")).alias("modified"))
    asked = _written(spark, folder).select("event_id", "bucket", "key", "etag", "event_time").join(rows, ["bucket", "key"])
    none = F.lit(None)
    outcome = M.condition(F.col("held"), F.col("modified"), none.cast("string"), F.col("etag"), F.col("event_time"), none.cast("timestamp"))
    strict = M.condition(F.col("held"), F.col("modified"), F.col("etag"), none.cast("string"), none.cast("timestamp"), F.col("event_time"), copying=True)
    return asked.select("event_id", outcome.alias("outcome"), strict.alias("copy_outcome"))


# Functions.


def digests(spark: SparkSession, folder: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return table(spark, folder, "documents").select("doc_id", D.etag(content).alias("etag"), D.sha256_base64(content).alias("sha256"), D.sha1_base64(content).alias("sha1"), F.octet_length("text").alias("size"))


def crc_digests(spark: SparkSession, folder: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return table(spark, folder, "documents").select("doc_id", D.crc32_base64(content).alias("crc32"), D.crc32c_base64(content).alias("crc32c"))


def content_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "disk_snapshot").select("name").distinct()
    return S.with_content_type(rows, "name")


def key_parts(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("key")
    return catalogue(spark, folder, "key").select("id", S.key_prefix(k).alias("prefix"), S.key_name(k).alias("name"), S.slashes(k).alias("depth"), S.uri_encode(k, True).alias("encoded"), S.xml_escape(k).alias("escaped"))


def scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Which keys scans of a subtree and of some files cover."""
    files = ["archive/delta/index.html", "readme.txt"]
    return catalogue(spark, folder, "key").select("id", C.in_scope(F.col("key"), "archive/").alias("in_subtree"), C.in_scope(F.col("key"), files=files).alias("in_files"), C.in_scope(F.col("key")).alias("in_bucket"))


def file_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys, and what may be made of them: whether each may name a file."""
    k = F.col("key")
    made = F.array(k, F.concat(F.lit("/"), k), F.regexp_replace(k, "/", "/../"), F.concat(F.lit(".shelfmark/"), k), F.lit(""))
    return catalogue(spark, folder, "key").select("id", F.posexplode(made).alias("n", "made")).select("id", "n", S.names_a_file(F.col("made")).alias("names_a_file"))


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of parts read as durations in each unit, and in one that is none."""
    units = F.array(*[F.lit(u) for u in ("s", "m", "h", "d", "w", "")])
    rows = table(spark, folder, "parts").select("part_number").distinct()
    text = F.concat(F.col("part_number").cast("string"), "unit")
    return rows.select("part_number", F.explode(units).alias("unit")).select(text.alias("text"), F.coalesce(S.duration_seconds(text), F.lit(-1)).alias("seconds"))


def copy_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of copies as they are sent: a bucket and an encoded key."""
    source = F.concat(F.lit("/"), "bucket", F.lit("/"), S.uri_encode(F.col("key"), True))
    rows = catalogue(spark, folder, "key", where=F.col("key").isNotNull())
    return rows.select("id", S.bucket_and_key(source).alias("s")).select("id", "s.bucket", "s.key")


def metadata_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of metadata written as JSON and read again; a text that is cut off is empty metadata."""
    text = F.to_json("metadata")
    rows = catalogue(spark, folder).select("id", S.json_map(text).alias("whole"), S.json_map(F.substring(text, 1, 5)).alias("cut"))
    return rows.select("id", F.size("whole").alias("entries"), F.size("cut").alias("entries_cut"))


def metadata_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata sent as headers, among others, and found again by their prefix."""
    named = F.transform_keys("metadata", lambda k, v: F.concat(F.lit("X-Amz-Meta-"), F.upper(k)))
    both = F.map_concat(named, F.create_map(F.lit("content-type"), F.lit("x")))
    rows = catalogue(spark, folder).filter("metadata is not null").select("id", S.headers_with_prefix(both, "x-amz-meta-").alias("m"))
    return rows.select("id", F.explode("m").alias("name", "value"))


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """By bucket the rate at which files would have been hashed in ten seconds, had all that are known been of the size of those done."""
    rows = catalogue(spark, folder, "scan_level", "size")
    done = F.col("scan_level") >= 3
    sums = rows.groupBy("bucket").agg(F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("size"), F.count_if(done).alias("done"), F.count(F.lit(1)).alias("tried"))
    return sums.select("bucket", F.round(S.extrapolated_rate(F.col("size"), F.col("done"), F.col("tried"), F.lit(10.0)), 3).alias("rate"))


def size_texts(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue(spark, folder, "size").select("id", S.human_size(F.col("size")).alias("size_text"))


def bucket_names(spark: SparkSession, folder: str) -> DataFrame:
    """Bucket names made of directories, and what is wrong with the directories' own names as bucket names."""
    path = F.rtrim("prefix", F.lit("/"))
    rows = table(spark, folder, "directories").select(path.alias("path")).distinct()
    return rows.select("path", S.bucket_name(F.col("path")).alias("name"), S.bucket_name_problem(F.element_at(F.split("path", "/"), -1)).alias("problem"))


def date_texts(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("event_time")
    rows = table(spark, folder, "object_events").select("event_time").distinct()
    parsed = F.unix_micros(S.parse_http_date(S.http_date(at)))
    return rows.select(F.unix_micros(at).alias("event_us"), S.http_date(at).alias("http_date"), S.rfc3339(at).alias("rfc3339"), parsed.alias("parsed_us"))


def byte_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The first half, all but the first kilobyte and the last kilobyte of each object, as byte ranges."""
    size = F.col("size")
    headers = F.array(F.format_string("bytes=0-%d", F.floor(size / 2)), F.lit("bytes=1024-"), F.lit("bytes=-1024"))
    rows = catalogue(spark, folder, "size", where=F.col("size").isNotNull()).select("id", "size", F.explode(headers).alias("header"))
    return rows.withColumn("r", S.byte_range(F.col("header"), size)).select("id", "header", F.col("r.first").alias("first"), F.col("r.last").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        dup_groups, dup_members, dup_first_size, dup_page, dup_page2, dup_page_more, dup_cross_members, dup_partial, dup_key_contains, dup_key_depth, dup_cross_bucket, bucket_stats,
        dir_hashes, dup_dirs, dup_dirs_members, dup_dirs_prefix, dup_dirs_min_files, dup_dirs_page, dup_dirs_page_more, compare_dirs, compare_buckets, compare_buckets_by_key, compare_summary,
        list_flat, list_prefix, list_page, list_keys, list_delimiter, list_delimiter_below, list_entries_page, list_bucket_delimiter, list_bucket_delimiter_below, list_bucket_entries_page, list_bucket_entries_more, list_page_more, list_by_parent, list_root, list_buckets, get_objects, get_object, get_by_inode,
        count_objects, scan_status, remaining, at_level_3, below_level_page, byte_budget, byte_budget_next, upload_throughput,
        l1_classify, l1_moves, l1_stale, l1_report, l1_next, upsert_latest, delete_anti, bulk_delete, rename_apply, rename_outcomes, enrich_monotone, reset_level, copy_apply, merge_plan, stale_dirs,
        integrity_reasons, integrity_rollup, tags_get, tags_limits, multipart_etag, multipart_check, multipart_list, abandoned_uploads, webhook_match, cors_match, conditional_get,
        digests, crc_digests, content_types, key_parts, scopes, file_keys, durations, copy_sources, metadata_texts, metadata_headers, rates, size_texts, bucket_names, date_texts, byte_ranges,
    )
}
