"""Values that feeds spell in several ways, brought to one form. All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The type given to content of unknown kind.
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# Texts that say only that nothing is known.
UNKNOWN_WORDS = ["unknown", "unspecified", "n/a", "na", "none", "null", "nil", "-", "?", "tbd"]


def canonical_uuid(c: Column) -> Column:
    """Lower-case hyphenated form of a UUID in any usual spelling; other text lower-cased and trimmed.

    Case, white space, braces, quotes, hyphens and a urn:uuid: prefix are not told apart. A text in the
    usual form is only looked at once.
    """
    text = F.lower(F.regexp_replace(c, r'[\s{}"()]', ""))
    text = F.regexp_replace(text, "^urn:uuid:", "")
    digits = F.replace(text, F.lit("-"), F.lit(""))
    hyphenated = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    usual = c.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")
    return F.when(c.isNull() | usual, c).when(digits.rlike("^[0-9a-f]{32}$"), hyphenated).otherwise(text)


def event_kind(c: Column) -> Column:
    """The name of an event in lower case, without white space around it and without the service's name before it."""
    return F.regexp_replace(F.lower(F.trim(c)), "^s3:", "")


def plain_key(c: Column) -> Column:
    """An object key as stored: percent escapes and plus signs of the form encoding undone, no leading slash.

    A text with a malformed escape is no encoded key and stays as it is.
    """
    encoded = c.rlike(r"%[0-9A-Fa-f]{2}|\+")
    return F.ltrim(F.when(encoded, F.coalesce(F.try_url_decode(c), c)).otherwise(c), F.lit("/"))


def joined_path(prefix: Column, name: Column) -> Column:
    """prefix and name as one relative key: forward slashes, no empty or '.' segments; null counts as empty."""
    path = F.concat_ws("/", F.replace(F.coalesce(prefix, F.lit("")), F.lit("\\"), F.lit("/")), F.coalesce(name, F.lit("")))
    return F.array_join(F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")), "/")


def epoch_ns(c: Column) -> Column:
    """A time as epoch nanoseconds, whichever of s, ms, us and ns its magnitude shows; zero is null.

    Seconds reach 1e11 in the year 5138, so that magnitudes tell the units apart from 1973 on.
    """
    size = F.abs(c)
    return (
        F.when(c.isNull() | (c == 0), F.lit(None).cast("long"))
        .when(size < 10**11, c * F.lit(10**9))
        .when(size < 10**14, c * F.lit(10**6))
        .when(size < 10**17, c * F.lit(1000))
        .otherwise(c)
        .cast("long")
    )


def ns_to_timestamp(c: Column) -> Column:
    """Epoch nanoseconds as a timestamp, cut to microseconds; whole seconds are exact as doubles, so nothing is rounded."""
    second = F.lit(10**9)
    rest = F.pmod(c, second)
    return F.timestamp_micros(((c - rest) / second).cast("long") * 10**6 + (rest / 1000).cast("long"))


def _usual_digest(c: Column) -> Column:
    """Whether a text is 32 bytes in padded base64, with no stray bits in its last letter."""
    return c.rlike(r"^[A-Za-z0-9+/]{42}[AEIMQUYcgkosw048]=\z")


def _odd_digest(c: Column) -> Column:
    """The 32 bytes of a digest in another spelling, or null."""
    bare = F.regexp_replace(c, r"""[\s"']""", "")
    unlabelled = F.regexp_replace(bare, "(?i)^sha-?256[:=-]", "")
    text = F.when(F.length(unlabelled).isin(43, 44, 64), unlabelled).otherwise(bare)
    core = F.rtrim(F.translate(text, "-_", "+/"), F.lit("="))
    return (
        F.when(text.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(text))
        .when(core.rlike("^[A-Za-z0-9+/]{43}$"), F.try_to_binary(F.concat(core, F.lit("=")), F.lit("base64")))
        .otherwise(F.lit(None).cast("binary"))
    )


def digest32(c: Column) -> Column:
    """The 32 bytes that a SHA-256 text denotes, or null.

    Hex in any case, base64 in either alphabet, padded or not, with a sha256 label, quotes or
    white space around it, are one digest.
    """
    return F.when(_usual_digest(c), F.unbase64(c)).when(c.isNotNull(), _odd_digest(c))


def digest_text(c: Column) -> Column:
    """The padded base64 of what digest32 gives; a text in that form is only looked at once."""
    return F.when(_usual_digest(c), c).when(c.isNotNull(), F.base64(_odd_digest(c)))


def known_text(c: Column) -> Column:
    """The text if it says anything: not null, blank, bare quotes, a word for unknown or the default type."""
    bare = F.lower(F.regexp_replace(c, r"""[\s"']""", ""))
    return F.when(c.isNotNull() & (bare != "") & ~bare.isin(UNKNOWN_WORDS) & (bare != DEFAULT_CONTENT_TYPE), c)


def known_map(c: Column) -> Column:
    """The map if it has entries."""
    return F.when(F.size(c) > 0, c)


def month_of(c: Column) -> Column:
    """Months since year 0 of a timestamp, in the session's time zone, which is UTC throughout."""
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def month_text(c: Column) -> Column:
    """'2025-03' for a month number of month_of."""
    return F.format_string("%04d-%02d", F.floor(c / 12).cast("int"), (F.pmod(c, F.lit(12)) + 1).cast("int"))
