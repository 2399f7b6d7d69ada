"""Storing objects: whole and in parts, and what a request for one comes to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.digests import with_digests
from shelfmark.functions.scalars import key_name, key_prefix
from shelfmark.functions.values import DEFAULT_CONTENT_TYPE
from shelfmark.operators.catalogue import new_id, upsert
from shelfmark.operators.matching import digest_mismatch
from shelfmark.operators.multipart import LAST_PART, check_request, composite_etags

#: Digests a client may claim, in the order they are checked.
CLAIMS = ("etag", "checksum_sha256", "checksum_sha1", "checksum_crc32", "checksum_crc32c")


def received(uploads: DataFrame) -> DataFrame:
    """uploads(bucket, key, content, claimed_...) with sizes, digests and refused: the first claimed digest that is another, or null."""
    made = with_digests(uploads, "content").withColumn("size", F.octet_length("content").cast("long"))
    claimed = {c: F.col(f"claimed_{c}") for c in CLAIMS if f"claimed_{c}" in uploads.columns}
    return made.withColumn("refused", digest_mismatch({c: F.col(c) for c in CLAIMS}, claimed))


def stored(existing: DataFrame, uploads: DataFrame, now_ns: int) -> DataFrame:
    """The catalogue with what was received and not refused put in at level 3; the file's own time, if given as file_mtime_ns, is kept."""
    rows = uploads.filter("refused is null").withColumns({
        "id": new_id(F.col("bucket"), F.col("key"), F.lit(now_ns)), "prefix": key_prefix(F.col("key")), "name": key_name(F.col("key")),
        "scan_level": F.lit(3), "created_at_ns": F.lit(now_ns), "last_modified_ns": F.lit(now_ns),
    })
    return upsert(existing, rows, ["bucket", "key"], ["last_modified_ns"])


def accepted(parts: DataFrame) -> DataFrame:
    """Parts with refused: why a part can't be taken, or null."""
    bad = F.col("part_number").isNull() | ~F.col("part_number").between(1, LAST_PART)
    return parts.withColumn("refused", F.when(F.col("upload_id").isNull(), "no_such_upload").when(bad, "invalid_part_number"))


def completed(uploads: DataFrame, parts: DataFrame, requested: DataFrame, now_ns: int) -> tuple[DataFrame, DataFrame]:
    """(objects, outcomes) of putting uploads together from requested(upload_id, position, part_number, etag).

    An upload that is not there is no_such_upload; one of whose requested parts is missing or has
    another tag is invalid_part. Objects start at level 2: their tag is the composite one, and digests
    of the whole come later.
    """
    asked = requested.select("upload_id", "position", "part_number", "etag")
    checked = check_request(asked, parts).join(parts.select("upload_id", "part_number", "size"), ["upload_id", "part_number"], "left")
    whole = checked.groupBy("upload_id").agg(F.bool_and("valid").alias("whole"))
    there = uploads.dropDuplicates(["id"]).withColumnRenamed("id", "upload_id")
    outcome = F.when(F.col("key").isNull(), "no_such_upload").when(~F.col("whole"), "invalid_part").otherwise("complete")
    outcomes = whole.join(there, "upload_id", "left").withColumn("outcome", outcome)
    rows = outcomes.filter("outcome = 'complete'").join(composite_etags(checked), "upload_id")
    objects = rows.select(
        "bucket", new_id(F.col("bucket"), F.col("key"), F.lit(now_ns)).alias("id"), key_prefix(F.col("key")).alias("prefix"), key_name(F.col("key")).alias("name"), "key", "size", "etag",
        F.coalesce("content_type", F.lit(DEFAULT_CONTENT_TYPE)).alias("content_type"), F.lit(2).alias("scan_level"), F.lit(now_ns).alias("created_at_ns"), F.lit(now_ns).alias("last_modified_ns"),
    )
    return objects, outcomes.select("upload_id", "outcome")


def present(catalogue: DataFrame, files: DataFrame, on: Sequence[str] = ("bucket", "key")) -> DataFrame:
    """Rows of the catalogue whose file is there too."""
    return catalogue.join(files.select(*on), list(on), "left_semi")


def recursive_sizes(df: DataFrame) -> DataFrame:
    """(bucket, directory, files, bytes) of each directory with all below it; '' is the whole bucket.

    Files are summed by their own directory first, map-side, so that what is repeated for each level is
    one row per directory and not per file.
    """
    own = df.groupBy("bucket", "prefix").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s"))
    parts = F.split(F.rtrim("prefix", F.lit("/")), "/")
    depth = F.when(F.col("prefix") == "", 0).otherwise(F.size(parts))
    above = F.transform(F.sequence(F.lit(0), depth), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    each = own.select("bucket", F.explode(above).alias("directory"), "n", "s")
    return each.groupBy("bucket", "directory").agg(F.sum("n").alias("files"), F.sum("s").alias("bytes"))


def with_stored_hashes(directories: DataFrame, hashes: DataFrame) -> DataFrame:
    """directories with hash, count and size of hashes put in and no longer stale; hashes of no row are left out."""
    new = hashes.select("bucket", "prefix", F.struct("dir_hash", "file_count", "total_size").alias("_h"))
    joined = directories.join(new, ["bucket", "prefix"], "left")
    use = F.col("_h").isNotNull()
    out = {c: F.when(use, F.col(f"_h.{c}")).otherwise(F.col(c)) for c in ("dir_hash", "file_count", "total_size")}
    return joined.withColumns({**out, "stale": F.when(use, F.lit(False)).otherwise(F.col("stale"))}).select(*directories.columns)


def unhashed_directories(directories: DataFrame) -> DataFrame:
    """Directories but the root that are stale or have no hash."""
    return directories.filter((F.col("prefix") != "") & (F.coalesce("stale", F.lit(True)) | F.col("dir_hash").isNull()))


def canonical_query(text: Column) -> Column:
    """A query string with each part decoded and encoded again, sorted by name and value."""
    from shelfmark.functions.scalars import uri_encode

    def plain(part: Column) -> Column:
        return uri_encode(F.coalesce(F.try_url_decode(part), part))

    def pair(p: Column) -> Column:
        return F.struct(plain(F.substring_index(p, "=", 1)).alias("name"), plain(F.regexp_replace(p, "^[^=]*=?", "")).alias("value"))

    pairs = F.array_sort(F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), pair))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")


def expired(signed: Column, seconds: Column, now: Column) -> Column:
    """Whether a compact date plus so many seconds is over, or the date is no date or yet to come."""
    from shelfmark.functions.scalars import parse_compact_date

    passed = F.unix_seconds(now) - F.unix_seconds(parse_compact_date(signed))
    return F.coalesce((passed < 0) | (passed > seconds), F.lit(True))


def listing_xml(df: DataFrame, root: str, namespace: str) -> Column:
    """All columns of a row as an XML element with a namespace."""
    row = F.to_xml(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"rowTag": root})
    return F.regexp_replace(row, f"^<{root}>", f'<{root} xmlns="{namespace}">')


RULES = "array<struct<allowed_origins:array<string>,allowed_methods:array<string>,allowed_headers:array<string>,expose_headers:array<string>,max_age_seconds:int>>"
WEBHOOKS = "array<struct<id:string,url:string,events:array<string>,filter:struct<prefix:string,suffix:string>>>"


def parsed_config(df: DataFrame, value: str, schema: str) -> DataFrame:
    """df with a JSON column parsed; a text that is not JSON of that form is an error."""
    return df.withColumn(value, F.from_json(value, schema, {"mode": "FAILFAST"}))
