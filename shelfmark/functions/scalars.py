"""Scalar functions of keys, names, sizes, dates and headers, as expressions."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.values import DEFAULT_CONTENT_TYPE


def key_name(key: Column) -> Column:
    """What follows the last slash of a key."""
    return F.element_at(F.split(key, "/"), -1)


def key_prefix(key: Column) -> Column:
    """A key up to and with its last slash; '' at the root."""
    return F.left(key, F.length(key) - F.length(key_name(key)))


def slashes(text: Column) -> Column:
    """How many slashes a text has."""
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))


def content_types() -> dict[str, str]:
    """Content type by extension: the tables Python ships, without what a machine adds to them."""
    own = mimetypes.MimeTypes(filenames=())
    return {ext[1:]: kind for ext, kind in sorted(own.types_map[True].items())}


def with_content_type(df: DataFrame, name: str, out: str = "content_type") -> DataFrame:
    """df with the content type of a file name's extension, or the default; the table is a constant of some hundred rows."""
    kinds = df.sparkSession.createDataFrame(list(content_types().items()), "_ext string, _kind string")
    ext = F.lower(F.regexp_extract(F.col(name), r"[^./]\.([^./]+)$", 1))
    joined = df.withColumn("_ext", ext).join(F.broadcast(kinds), "_ext", "left")
    return joined.withColumn(out, F.coalesce("_kind", F.lit(DEFAULT_CONTENT_TYPE))).drop("_ext", "_kind")


def human_size(size: Column) -> Column:
    """'1.5 KB': bytes in the largest unit up to GB that is reached, by 1024, with one decimal, ties to even."""

    def unit(n: int, name: str) -> Column:
        return F.format_string(f"%.1f {name}", F.bround(size / F.lit(float(n)), 1))

    return (
        F.when(size >= 1 << 30, unit(1 << 30, "GB"))
        .when(size >= 1 << 20, unit(1 << 20, "MB"))
        .when(size >= 1 << 10, unit(1 << 10, "KB"))
        .when(size.isNotNull(), F.format_string("%d B", size))
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of '90s', '30m', '1h' or '7d'; null for anything else."""
    bare = F.trim(text)
    number = F.regexp_extract(bare, r"^\+?(\d+)[smhd]$", 1)
    factor = F.when(bare.endswith("s"), 1).when(bare.endswith("m"), 60).when(bare.endswith("h"), 3600).otherwise(86400)
    return F.when(number != "", number.cast("long") * factor)


def bucket_name(directory: Column) -> Column:
    """A bucket name made of a directory's name: lower case, other characters as hyphens, runs and ends trimmed.

    Names shorter than three characters get '-bucket' behind them; too long ones stay, and are invalid.
    """
    base = F.element_at(F.split(F.rtrim(directory, F.lit("/")), "/"), -1)
    text = F.regexp_replace(F.lower(base), "[^a-z0-9.-]", "-")
    text = F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit("-.")), "-{2,}", "-"), r"\.{2,}", ".")
    padded = F.when(text == "", "bucket").otherwise(F.concat(text, F.lit("-bucket")))
    return F.when(F.length(text) < 3, padded).otherwise(text)


def bucket_name_problem(name: Column) -> Column:
    """What is wrong with a bucket name, or null."""
    byte = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0*[0-9]{1,2})"
    return (
        F.when((F.octet_length(name) < 3) | (F.octet_length(name) > 63), "invalid_length")
        .when(name.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$"), "looks_like_ip_address")
        .when(~name.rlike("^[a-z0-9.-]*$"), "invalid_characters")
        .when(name.rlike("^[.-]|[.-]$"), "invalid_start_end")
        .when(name.contains("--") | name.contains(".."), "consecutive_hyphens_or_periods")
    )


def uri_encode(text: Column, keep_slash: bool = False) -> Column:
    """Percent encoding with upper-case hex that leaves letters, digits and -_.~ only, and slashes if asked."""
    out = F.url_encode(text)
    swaps = [("+", "%20"), ("*", "%2A"), ("%7E", "~")] + [("%2F", "/")] * keep_slash
    for a, b in swaps:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def http_date(at: Column) -> Column:
    """'Thu, 01 Jan 2025 00:00:00 GMT' for a timestamp."""
    day = F.element_at(F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), F.weekday(at) + 1)
    return F.concat(day, F.date_format(at, ", dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def parse_http_date(text: Column) -> Column:
    """The timestamp of an HTTP date; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))


def parse_compact_date(text: Column) -> Column:
    """The timestamp of '20250101T000000Z'; null if it is none."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def rfc3339(at: Column) -> Column:
    """'2025-01-01T00:00:00.000000Z' for a timestamp."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def xml_escape(text: Column) -> Column:
    """Text with the five XML entities in place of their characters."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def bucket_and_key(source: Column) -> Column:
    """A struct (bucket, key) of '/bucket/key', percent escapes undone; null if either part is missing."""
    plain = F.regexp_replace(F.coalesce(F.try_url_decode(source), source), "^/", "")
    bucket, key = F.regexp_extract(plain, "^([^/]+)/(.+)$", 1), F.regexp_extract(plain, "(?s)^([^/]+)/(.+)$", 2)
    return F.when(key != "", F.struct(bucket.alias("bucket"), key.alias("key")))


def byte_range(header: Column, size: Column) -> Column:
    """A struct (first, last) of 'bytes=a-b', 'bytes=a-' or 'bytes=-n' on so many bytes; null if the header is none.

    n beyond the size takes all of it.
    """
    a = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1)
    b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    first = F.when(a == "", F.greatest(size - F.try_to_number(b, F.lit("9" * 18)).cast("long"), F.lit(0))).otherwise(F.nullif(a, F.lit("")).cast("long"))
    last = F.when((a != "") & (b != ""), F.nullif(b, F.lit("")).cast("long")).otherwise(size - 1)
    return F.when(header.rlike(r"^bytes=(\d+-\d*|-\d+)$"), F.struct(first.alias("first"), last.alias("last")))


def json_map(text: Column) -> Column:
    """Metadata of a JSON text; an empty map if it is not JSON or null."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def headers_with_prefix(headers: Column, prefix: str) -> Column:
    """Entries of a header map whose lower-case name begins with prefix, with it taken off."""
    kept = F.map_filter(headers, lambda k, v: F.lower(k).startswith(prefix))
    return F.transform_keys(kept, lambda k, v: F.substring(F.lower(k), len(prefix) + 1, 1 << 20))


def percent_complete(done: Column, total: Column) -> Column:
    """done of total in percent; 100 of nothing."""
    return F.when(total == 0, 100.0).otherwise(done * 100.0 / total)


def byte_budget_for(rate: Column, seconds: int = 120, seed: int = 50 << 20, most: int = 50 << 30) -> Column:
    """Bytes to take on at a rate per second: what fits into the time, within limits; the seed without a rate."""
    return F.when(rate.isNull(), F.lit(seed).cast("long")).otherwise(F.least((rate * seconds).cast("long"), F.lit(most).cast("long")))


def readers_for(mean_size: Column) -> Column:
    """How many files to read at once, by their mean size."""
    return F.when(mean_size <= 512 << 10, 32).when(mean_size <= 1 << 20, 16).when(mean_size <= 8 << 20, 8).otherwise(1)


def extrapolated_rate(size: Column, done: Column, tried: Column, seconds: Column) -> Column:
    """Bytes per second, had all files that were tried been of the size of those done; null without time or files."""
    whole = F.when(done > 0, size * (tried / done)).otherwise(size)
    return F.when((seconds > 0) & (tried > 0), whole / seconds)


def names_a_file(key: Column, state: str = ".shelfmark") -> Column:
    """Whether a key may name a file, as far as its text tells: relative, no '..' part, not in the state folder."""
    parts = F.split(key, "/")
    return F.coalesce((key != "") & ~key.startswith("/") & ~F.array_contains(parts, "..") & ~key.contains("\0") & (F.get(parts, F.lit(0)) != state), F.lit(False))
