"""Multipart uploads: parts, their assembly, and what was left behind."""

from __future__ import annotations

from datetime import datetime
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.listing import cut

#: Part numbers go from 1 to this one.
LAST_PART = 10_000


def current_parts(parts: DataFrame) -> DataFrame:
    """The last upload of each part number of each upload; a part sent again replaces the one before."""
    rest = [c for c in parts.columns if c not in ("upload_id", "part_number")]
    newest = F.struct("uploaded_at", "id") if "id" in rest else F.struct("uploaded_at")
    return parts.groupBy("upload_id", "part_number").agg(F.max_by(F.struct(*rest), newest).alias("_p")).select("upload_id", "part_number", "_p.*")


def composite_etags(requested: DataFrame) -> DataFrame:
    """(upload_id, etag, parts, size) of parts put together in the order of position.

    requested has upload_id, position, etag and size. The tag is the MD5 over the raw MD5s of the parts,
    and their number. An upload has at most 10,000 parts, so a group is bounded. A part without a tag
    leaves the upload without one.
    """
    each = F.array_sort(F.collect_list(F.struct("position", F.replace("etag", F.lit('"'), F.lit("")).alias("hex"))))
    whole = F.unhex(F.array_join(F.transform(each, lambda p: p["hex"]), ""))
    n = F.count(F.lit(1))
    tag = F.when(F.count("etag") == n, F.concat(F.lit('"'), F.md5(whole), F.lit("-"), n.cast("string"), F.lit('"')))
    return requested.groupBy("upload_id").agg(tag.alias("etag"), n.alias("parts"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def check_request(requested: DataFrame, parts: DataFrame) -> DataFrame:
    """Each requested (upload_id, part_number, etag) with valid: whether that part is there with that tag."""
    there = parts.select("upload_id", "part_number", F.col("etag").alias("_etag"))
    return requested.join(there, ["upload_id", "part_number"], "left").withColumn("valid", F.coalesce(F.col("etag") == F.col("_etag"), F.lit(False))).drop("_etag")


def parts_page(parts: DataFrame, upload_id: str, limit: int = 1000, after: int = 0) -> DataFrame:
    """The next limit parts of an upload after a part number."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return parts.filter((F.col("upload_id") == upload_id) & (F.col("part_number") > after)).orderBy("part_number").limit(min(limit, 1000))


def uploads_page(uploads: DataFrame, limit: int, prefix: str = "", key_marker: Optional[str] = None, id_marker: Optional[str] = None) -> DataFrame:
    """The next limit uploads by key and id, after the markers; an id marker without a key marker gives none."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return _uploads(uploads, prefix, key_marker, id_marker).orderBy("key", "id").limit(limit)


def _uploads(uploads: DataFrame, prefix: str, key_marker: Optional[str], id_marker: Optional[str]) -> DataFrame:
    """Uploads under a prefix after the markers."""
    if id_marker and not key_marker:
        return uploads.limit(0)
    escaped = prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    rows = uploads.filter(F.col("key").ilike(f"{escaped}%"))
    if key_marker:
        later = F.col("key") > key_marker
        rows = rows.filter(later | ((F.col("key") == key_marker) & (F.col("id") > id_marker)) if id_marker else later)
    return rows


def parts_page_more(parts: DataFrame, upload_id: str, limit: int = 1000, after: int = 0) -> DataFrame:
    """parts_page with has_more and next_token, the number to go on after."""
    rows = parts.filter((F.col("upload_id") == upload_id) & (F.col("part_number") > after))
    return cut(rows, [F.col("part_number")], min(limit, 1000), F.col("part_number"))


def uploads_page_more(uploads: DataFrame, limit: int, prefix: str = "", key_marker: Optional[str] = None, id_marker: Optional[str] = None) -> DataFrame:
    """uploads_page with has_more and next_token, the key and id to go on after."""
    return cut(_uploads(uploads, prefix, key_marker, id_marker), [F.col("key"), F.col("id")], limit, F.struct(F.col("key").alias("key_marker"), F.col("id").alias("id_marker")))


def abandoned(uploads: DataFrame, parts: DataFrame, before: datetime) -> DataFrame:
    """(id, key, parts, bytes) of uploads begun before a moment, with what their parts take."""
    old = uploads.filter(F.col("initiated_at") < F.lit(before)).select("id", "bucket", "key").dropDuplicates(["id"])
    held = parts.groupBy(F.col("upload_id").alias("id")).agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return old.join(held, "id", "left").fillna(0, ["parts", "bytes"])


def without(uploads: DataFrame, parts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """uploads and parts without the uploads of gone(id)."""
    ids = gone.select("id").distinct()
    return uploads.join(ids, "id", "left_anti"), parts.join(ids.withColumnRenamed("id", "upload_id"), "upload_id", "left_anti")
