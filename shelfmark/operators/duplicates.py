"""Duplicate files and directories.

Groups form by one aggregation over narrow rows, combined map-side; members join their group once.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import slashes
from shelfmark.operators.listing import cut, token_of
from shelfmark.operators.skew import fragment_join, key_join
from shelfmark.session import materialise

# Files that systems drop into directories, no part of a directory's content.
JUNK = [".DS_Store", "Thumbs.db", "desktop.ini"]


def contains(text: Column, term: str) -> Column:
    """Whether the text holds the term, letter case apart; % and _ in the term are wildcards."""
    return text.ilike(f"%{term}%")


def groups(df: DataFrame, within: Sequence[str] = ("bucket",), key_contains: Optional[str] = None, max_depth: Optional[int] = None) -> DataFrame:
    """(within, checksum_sha256, files, total_size, wasted_size) of contents that several files have.

    With key_contains only groups that have a file whose key holds the term, at most max_depth
    directories deep; they still count all of their files. max_depth alone has no effect. Files without
    a hash are in no group; a null size counts as 0. What is wasted is the size of each copy but one,
    taking the largest size where sizes differ.
    """
    hashed = df.filter(F.col("checksum_sha256").isNotNull())
    size = F.coalesce(F.col("size"), F.lit(0))
    sums = [F.count(F.lit(1)).alias("files"), F.sum(size).alias("total_size"), F.max("size").alias("_one")]
    if key_contains is not None:
        match = contains(F.col("key"), key_contains)
        if max_depth is not None:
            match = match & (slashes(F.col("key")) <= max_depth)
        sums.append(F.max(F.coalesce(match, F.lit(False))).alias("_matched"))
    found = hashed.groupBy(*within, "checksum_sha256").agg(*sums).filter("files > 1")
    if key_contains is not None:
        found = found.filter("_matched")
    return found.withColumn("wasted_size", F.coalesce("_one", F.lit(0)) * (F.col("files") - 1)).drop("_one", "_matched")


def cross_bucket_groups(df: DataFrame) -> DataFrame:
    """Groups over all buckets together, with the number of buckets they touch; a group may lie in one."""
    counted = df.filter(F.col("checksum_sha256").isNotNull()).groupBy("checksum_sha256", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("s"))
    return counted.groupBy("checksum_sha256").agg(F.sum("n").alias("files"), F.sum("s").alias("total_size"), F.count(F.lit(1)).alias("buckets")).filter("files > 1")


def groups_page(found: DataFrame, limit: int, token: Optional[str] = None) -> DataFrame:
    """The next limit groups by size, largest first, then hash, after that of token; a bad token is ignored."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return _after_group(found, token).orderBy(F.col("total_size").desc(), "checksum_sha256").limit(limit)


def _after_group(found: DataFrame, token: Optional[str]) -> DataFrame:
    """Groups after that of a token, by size and hash."""
    if (last := decode_group_token(token)) is None:
        return found
    size, digest = last
    return found.filter((F.col("total_size") < size) | ((F.col("total_size") == size) & (F.col("checksum_sha256") > digest)))


def groups_page_more(found: DataFrame, limit: int, token: Optional[str] = None) -> DataFrame:
    """groups_page with has_more and next_token."""
    after = _after_group(found, token)
    here = token_of(F.concat_ws(":", F.col("total_size").cast("string"), "checksum_sha256"))
    return cut(after, [F.col("total_size").desc(), F.col("checksum_sha256")], limit, here)


def encode_group_token(size: int, digest: str) -> str:
    """A continuation token for a group."""
    return base64.b64encode(f"{size}:{digest}".encode()).decode()


def decode_group_token(token: Optional[str]) -> Optional[tuple[int, str]]:
    """(size, hash) of a token, or None."""
    try:
        size, _, digest = base64.b64decode(token or "", validate=True).decode().partition(":")
        return (int(size), digest) if digest else None
    except ValueError:
        return None


def cross_bucket_report(df: DataFrame, limit: int) -> DataFrame:
    """(checksum_sha256, bucket, key, truncated): the files of the first limit groups over all buckets, by hash, and whether there are more groups."""
    first = materialise(cut(cross_bucket_groups(df).select("checksum_sha256"), [F.col("checksum_sha256")], limit, F.lit(None).cast("string")))
    found = key_join(df.select("checksum_sha256", "bucket", "key"), first.select("checksum_sha256", F.col("has_more").alias("truncated")), ["checksum_sha256"])
    return found.select("checksum_sha256", "bucket", "key", "truncated")


def groups_so_far(df: DataFrame, allow_partial: bool = False) -> DataFrame:
    """groups of each bucket, with scan_complete and pending: whether all of its files have been hashed, and how many have not.

    Unless a partial answer is allowed, a bucket that is not complete is an error.
    """
    from shelfmark.operators.stats import ScanPending, scan_status

    status = materialise(scan_status(df).select("bucket", "pending"))
    if not allow_partial and (waiting := status.filter("pending > 0").orderBy("bucket").first()):
        raise ScanPending(f"{waiting.pending} files of {waiting.bucket} are pending")
    return groups(df).join(status, "bucket").withColumn("scan_complete", F.col("pending") == 0)


def members(df: DataFrame, found: DataFrame, within: Sequence[str] = ("bucket",)) -> DataFrame:
    """Files of the groups found; a content that most files have is split over tasks."""
    return fragment_join(df, found.select(*within, "checksum_sha256"), [*within, "checksum_sha256"], "left_semi")


def members_of(df: DataFrame, digest: str) -> DataFrame:
    """Files of one content in the order of bucket and listing."""
    return df.filter(F.col("checksum_sha256") == digest).orderBy("bucket", "prefix", "name")


def directories_of(directories: DataFrame, dir_hash: str) -> DataFrame:
    """Directories of one hash, stale ones too, in order."""
    return directories.filter(F.col("dir_hash") == dir_hash).orderBy("bucket", "prefix")


def directory_hashes(df: DataFrame) -> DataFrame:
    """(bucket, prefix, dir_hash, file_count, total_size) of each directory but the root.

    The hash is over 'name:hash' lines of the directory's own files, sorted by name bytewise, junk left
    out. A directory with a file that has no hash, or with none left, has none. A directory is one
    group: it holds the names of its files, which a listing of it holds as well.
    """
    junk = F.coalesce(F.col("name").isin(JUNK), F.lit(False))
    lines = F.array_sort(F.collect_list(F.when(~junk & F.col("checksum_sha256").isNotNull(), F.struct("name", "checksum_sha256"))))
    per = df.filter("prefix <> ''").groupBy("bucket", "prefix").agg(
        F.coalesce(F.sum(F.when(~junk & F.col("checksum_sha256").isNull(), 1)), F.lit(0)).alias("_open"),
        F.count(F.when(~junk, 1)).cast("int").alias("file_count"),
        F.coalesce(F.sum(F.when(~junk, F.col("size"))), F.lit(0)).alias("total_size"),
        lines.alias("_lines"),
    )
    text = F.array_join(F.transform("_lines", lambda x: F.concat(x["name"], F.lit(":"), x["checksum_sha256"], F.lit("\n"))), "")
    return per.select("bucket", "prefix", F.when((F.col("_open") == 0) & (F.col("file_count") > 0), F.sha2(text, 256)).alias("dir_hash"), "file_count", "total_size")


def directory_groups(directories: DataFrame, within: Sequence[str] = ("bucket",), min_files: int = 1, prefix: Optional[str] = None, max_depth: Optional[int] = None) -> DataFrame:
    """(within, dir_hash, directories, file_count, total_size) of hashes several directories share.

    Stale directories and those without a hash are in none. With prefix or max_depth only groups that
    have a directory whose prefix begins so, letter case apart and % and _ as wildcards, at most so many
    levels below it; they still count all of their directories.
    """
    usable = directories.filter(F.col("dir_hash").isNotNull() & ~F.coalesce("stale", F.lit(False)) & (F.col("file_count") >= min_files))
    sums = [F.count(F.lit(1)).alias("directories"), F.min("file_count").alias("file_count"), F.sum(F.coalesce("total_size", F.lit(0))).alias("total_size")]
    if prefix is not None or max_depth is not None:
        match = F.col("prefix").ilike(f"{prefix or ''}%")
        if max_depth is not None:
            match = match & (slashes(F.col("prefix")) <= (prefix or "").count("/") + max_depth)
        sums.append(F.max(match).alias("_matched"))
    found = usable.groupBy(*within, "dir_hash").agg(*sums).filter("directories > 1")
    return found.filter("_matched").drop("_matched") if "_matched" in found.columns else found


def directory_members(directories: DataFrame, found: DataFrame, within: Sequence[str] = ("bucket",), min_files: int = 1) -> DataFrame:
    """Directories of the groups found, stale ones left out."""
    usable = directories.filter(F.col("dir_hash").isNotNull() & ~F.coalesce("stale", F.lit(False)) & (F.col("file_count") >= min_files))
    return fragment_join(usable, found.select(*within, "dir_hash"), [*within, "dir_hash"], "left_semi")


def directories_page(found: DataFrame, limit: int, after: Optional[str] = None) -> DataFrame:
    """The next limit directory groups by hash."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return (found.filter(F.col("dir_hash") > after) if after else found).orderBy("dir_hash").limit(limit)


def encode_directory_token(digest: str) -> str:
    """A continuation token for a group of directories."""
    return base64.b64encode(digest.encode()).decode()


def decode_directory_token(token: Optional[str]) -> Optional[str]:
    """The hash of a token, or None."""
    try:
        return base64.b64decode(token or "", validate=True).decode() or None
    except ValueError:
        return None


def directories_page_more(found: DataFrame, limit: int, token: Optional[str] = None) -> DataFrame:
    """The next limit directory groups by hash, after that of a token, with has_more and next_token; a bad token is ignored."""
    after = decode_directory_token(token)
    found = found.filter(F.col("dir_hash") > after) if after else found
    return cut(found, [F.col("dir_hash")], limit, token_of(F.col("dir_hash")))


def compare(left: DataFrame, right: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """(by, status, left_hash, right_hash) of a full comparison by relative path.

    left and right have by and checksum_sha256. Files without a hash on both sides are identical: null
    equals null. Status is identical, modified, only_in_left or only_in_right.
    """
    a = left.select(*by, F.col("checksum_sha256").alias("left_hash"), F.lit(True).alias("_l"))
    b = right.select(*by, F.col("checksum_sha256").alias("right_hash"), F.lit(True).alias("_r"))
    status = (
        F.when(F.col("_r").isNull(), "only_in_left").when(F.col("_l").isNull(), "only_in_right")
        .when(F.col("left_hash").eqNullSafe(F.col("right_hash")), "identical").otherwise("modified")
    )
    return a.join(b, list(by), "full").select(*by, status.alias("status"), "left_hash", "right_hash")


def compare_summary(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by status, and whether both sides are the same and not empty."""
    statuses = ("identical", "only_in_left", "only_in_right", "modified")
    counts = [F.count_if(F.col("status") == s).alias(f"files_{s}") for s in statuses]
    same = (F.count_if(F.col("status") == "identical") == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0)
    return compared.groupBy(*by).agg(*counts, same.alias("identical"))


def first_sizes(df: DataFrame, within: Sequence[str] = ("bucket",)) -> DataFrame:
    """(within, checksum_sha256, size): the size of each content's first file in listing order."""
    first = F.min_by(F.col("size"), F.struct("prefix", "name"))
    return df.filter(F.col("checksum_sha256").isNotNull()).groupBy(*within, "checksum_sha256").agg(first.alias("size"))
