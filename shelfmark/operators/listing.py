"""Listings of a catalogue: by prefix, rolled up at a delimiter, page by page.

Files list in the order of (prefix, name), so those of the root come before all directories.
Listings filter stored columns, which Parquet readers get as pushed filters, and end in a top-k, which
each task takes before anything is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

ORDER = ["prefix", "name"]


def under(key: Column, prefix: str) -> Column:
    """Keys that begin with prefix, byte by byte."""
    return key.startswith(prefix) if prefix else F.lit(True)


def beyond(after: Optional[tuple[str, str]]) -> Column:
    """Rows that come after (prefix, name) in listing order."""
    if after is None:
        return F.lit(True)
    prefix, name = after
    return (F.col("prefix") > prefix) | ((F.col("prefix") == prefix) & (F.col("name") > name))


def token_of(text: Column) -> Column:
    """A continuation token for a text: its base64, in one line."""
    return F.regexp_replace(F.base64(text.cast("binary")), r"\s", "")


def cut(found: DataFrame, order: Sequence[Column], limit: int, token: Column) -> DataFrame:
    """The first limit rows in an order that is total, with has_more and, if there are more, next_token: that of the last row.

    One row more than the limit is taken to see whether there are more; the windows see no others.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    top = found.withColumn("_token", token).orderBy(*order).limit(limit + 1)
    turn, whole = F.row_number().over(Window.orderBy(*order)), Window.partitionBy(F.lit(0))
    top = top.withColumn("_turn", turn).withColumn("has_more", F.max("_turn").over(whole) > limit)
    last = F.max(F.when(F.col("_turn") == limit, F.col("_token"))).over(whole)
    return top.withColumn("next_token", F.when(F.col("has_more"), last)).filter(F.col("_turn") <= limit).drop("_turn", "_token")


def page_more(df: DataFrame, limit: int, prefix: str = "", token: Optional[str] = None) -> DataFrame:
    """page, after the key of a token, with has_more and next_token; a token that can't be read is ignored."""
    key = decode_token(token)
    after = None if key is None else (key[: key.rfind("/") + 1], key[key.rfind("/") + 1 :])
    found = df.filter(under(F.col("key"), prefix) & beyond(after))
    return cut(found, [F.col(c) for c in ORDER], limit, token_of(F.col("key")))


def page(df: DataFrame, limit: int, prefix: str = "", after: Optional[tuple[str, str]] = None) -> DataFrame:
    """The first limit rows under prefix after a place, in listing order; limit is at least 1."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return df.filter(under(F.col("key"), prefix) & beyond(after)).orderBy(*ORDER).limit(limit)


def stream(df: DataFrame, prefix: str = "", after: Optional[tuple[str, str]] = None) -> Iterator[Row]:
    """All rows under prefix after a place in listing order, one partition at a time on the driver."""
    return df.filter(under(F.col("key"), prefix) & beyond(after)).orderBy(*ORDER).toLocalIterator(prefetchPartitions=True)


def children(df: DataFrame, directory: str) -> DataFrame:
    """Files directly in a directory; '' is the root."""
    return df.filter(F.col("prefix") == (f"{directory.rstrip('/')}/" if directory else ""))


def entries(df: DataFrame, prefix: str = "", delimiter: str = "/", within: Sequence[str] = ()) -> DataFrame:
    """(within, kind, entry, size) of what is under prefix: objects, and common prefixes for keys with the delimiter after it.

    A common prefix has the size of nothing. Without a delimiter all are objects. Null keys are left out.
    Entries of buckets stay apart where within has the bucket, else equal ones are one.
    """
    rows = df.filter(F.col("key").isNotNull() & under(F.col("key"), prefix))
    if not delimiter:
        return rows.select(*within, F.lit("object").alias("kind"), F.col("key").alias("entry"), "size")
    rest = F.substring(F.col("key"), len(prefix) + 1, 1 << 30)
    at = F.instr(rest, delimiter)
    rolled = rows.select(
        *within,
        F.when(at > 0, "prefix").otherwise("object").alias("kind"),
        F.when(at > 0, F.left(F.col("key"), F.lit(len(prefix)) + at + len(delimiter) - 1)).otherwise(F.col("key")).alias("entry"),
        F.when(at == 0, F.col("size")).alias("size"),
    )
    return rolled.groupBy(*within, "kind", "entry").agg(F.max("size").alias("size"))


def entries_page(df: DataFrame, limit: int, prefix: str = "", delimiter: str = "/", token: Optional[str] = None, within: Sequence[str] = ()) -> DataFrame:
    """A page of entries in bytewise order of within and entry after that of token, with has_more and next_token on each row.

    Pages are cut from rolled-up entries, so an entry is on one page only and none is lost between two.
    Keys below the last common prefix are skipped by the scan already. A token is made of the last row's
    entry, and of its values of within before that; one made of fewer is ignored.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    last = decode_token(token)
    if last is not None and last.count("\0") >= len(within):
        *place, last = last.split("\0", len(within))
        below = F.col("key").startswith(last) if delimiter and last.endswith(delimiter) else F.lit(False)
        after = (F.col("key") > last) & ~below
        for c, v in reversed(list(zip(within, place))):
            after = (F.col(c) > v) | ((F.col(c) == v) & after)
        df = df.filter(after)
    here = F.concat_ws("\0", *within, "entry")
    return cut(entries(df, prefix, delimiter, within), [F.col(c) for c in (*within, "entry", "kind")], limit, token_of(here))


def encode_token(text: str, *place: str) -> str:
    """A continuation token for an entry, and for the values of within it has."""
    return base64.b64encode("\0".join((*place, text)).encode()).decode()


def decode_token(token: Optional[str]) -> Optional[str]:
    """The entry of a token; None without one, or if it can't be read."""
    try:
        return base64.b64decode(token, validate=True).decode() if token else None
    except ValueError:
        return None


def get(df: DataFrame, bucket: str, key: str) -> DataFrame:
    """The row of a key: a filter of the stored prefix and name, which the scan gets."""
    at = key.rfind("/") + 1
    return df.filter((F.col("bucket") == bucket) & (F.col("prefix") == key[:at]) & (F.col("name") == key[at:]))


def get_by_id(df: DataFrame, id: str) -> DataFrame:
    """The row of an id: an object, an upload or, by its number, a directory."""
    return df.filter(F.col("id") == id)


def get_by_identity(df: DataFrame, bucket: str, inode: int, device_id: int) -> DataFrame:
    """The first row, by key, of a file identity of a bucket."""
    return df.filter((F.col("bucket") == bucket) & (F.col("inode") == inode) & (F.col("device_id") == device_id)).orderBy("key").limit(1)


def by_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the keys of keys(position, bucket, key), with their position; keys without a row are left out."""
    return keys.join(df, ["bucket", "key"])
