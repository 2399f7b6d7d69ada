"""Keeping a catalogue current: comparison with what is on disk, and changes to its rows.

A catalogue is a table that is never changed in place. Each operation gives the rows of the next one,
or a plan of what would be done to files, which only an explicit call carries out.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ["inode", "device_id", "size"]


def new_id(bucket: Column, key: Column, created_ns: Column) -> Column:
    """The id of an object created at a place at some moment: repeatable, and another one than that of what was there before."""
    return F.sha2(F.concat_ws("/", bucket, key, created_ns), 256)


def in_scope(key: Column, subtree: Optional[str] = None, files: Optional[Sequence[str]] = None) -> Column:
    """Whether a scan covers a key: those files, that subtree, or the whole bucket."""
    if files is not None:
        return key.isin(list(files))
    return key.startswith(subtree) if subtree else F.lit(True)


def classify(catalogue: DataFrame, disk: DataFrame, scan_start_ns: Optional[Column] = None, scope: Optional[Column] = None) -> DataFrame:
    """(bucket, key, old_key, class) of each file: new, unchanged, modified, moved or deleted.

    Both tables have bucket, key, inode, device_id and size; a file listed twice counts once. A file at
    its key with equal identity is unchanged, null equal to null; with another it is modified. A new key
    with the known identity of a missing one is moved: of several that qualify on a side, the smallest
    key. Files missing from the disk are deleted, but for rows of catalogue created at or after
    scan_start_ns, which an upload may have added since. scope limits both sides.
    """
    cols = ["bucket", "key", *IDENTITY]
    created = [F.col("created_at_ns")] if scan_start_ns is not None else []
    scope = F.lit(True) if scope is None else scope
    old = catalogue.filter(scope).select(*cols, *created).dropDuplicates(["bucket", "key"])
    new = disk.filter(scope).select(*cols).dropDuplicates(["bucket", "key"])
    old = old.select("bucket", "key", F.struct(*IDENTITY).alias("old"), *created, F.lit(True).alias("was"))
    new = new.select("bucket", "key", F.struct(*IDENTITY).alias("new"), F.lit(True).alias("is"))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    both = old.join(new, ["bucket", "key"], "full").withColumn("class", kind)
    if scan_start_ns is not None:
        both = both.filter((F.col("class") != "deleted") | (F.col("created_at_ns") < scan_start_ns))
    both = both.select("bucket", "key", "class", F.coalesce("new", "old").alias("at"))
    known = F.col("at.inode").isNotNull() & F.col("at.device_id").isNotNull() & F.col("at.size").isNotNull()

    def smallest(which: str, name: str) -> DataFrame:
        return both.filter((F.col("class") == which) & known).groupBy("bucket", "at").agg(F.min("key").alias(name))

    moves = smallest("new", "key").join(smallest("deleted", "old_key"), ["bucket", "at"]).select("bucket", "key", "old_key")
    gone = moves.select("bucket", F.col("old_key").alias("key"), F.lit(True).alias("_gone"))
    out = both.join(moves, ["bucket", "key"], "left").join(gone, ["bucket", "key"], "left").filter(F.col("_gone").isNull())
    return out.select("bucket", "key", "old_key", F.when(F.col("old_key").isNotNull(), "moved").otherwise(F.col("class")).alias("class"))


def scan_report(classified: DataFrame) -> DataFrame:
    """Counts of each class by bucket."""
    classes = ("new", "unchanged", "modified", "moved", "deleted")
    return classified.groupBy("bucket").agg(*[F.count_if(F.col("class") == c).alias(c) for c in classes])


def next_catalogue(catalogue: DataFrame, disk: DataFrame, classified: DataFrame, now_ns: int) -> DataFrame:
    """The catalogue after a scan: moved rows keep all but key and time, modified and new ones start at level 1, deleted ones are gone."""
    source = F.coalesce("old_key", "key")
    live = classified.filter("class <> 'deleted'").select("bucket", "class", source.alias("key"), F.col("key").alias("_key"))
    kept = catalogue.join(live.filter("class <> 'new'"), ["bucket", "key"])
    fresh = F.col("class") == "modified"
    cleared = ["etag", "checksum_sha256", "checksum_sha1", "checksum_crc32", "checksum_crc32c"]
    found = disk.select("bucket", F.col("key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in IDENTITY]).dropDuplicates(["bucket", "_key"])
    out = kept.join(found, ["bucket", "_key"], "left")
    for c in IDENTITY:
        out = out.withColumn(c, F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)))
    for c in cleared:
        if c in catalogue.columns:
            out = out.withColumn(c, F.when(~fresh, F.col(c)))
    out = out.withColumns({
        "scan_level": F.when(fresh, F.lit(1)).otherwise(F.col("scan_level")).cast("int"),
        "last_modified_ns": F.when(F.col("class").isin("modified", "moved"), F.lit(now_ns)).otherwise(F.col("last_modified_ns")),
        "key": F.col("_key"),
    }).select(*catalogue.columns)
    added = disk.join(classified.filter("class = 'new'").select("bucket", "key"), ["bucket", "key"], "left_semi").dropDuplicates(["bucket", "key"])
    new = added.select("bucket", "key", *IDENTITY).withColumns({
        "id": new_id(F.col("bucket"), F.col("key"), F.lit(now_ns)), "scan_level": F.lit(1), "created_at_ns": F.lit(now_ns), "last_modified_ns": F.lit(now_ns),
    })
    out = out.unionByName(new, allowMissingColumns=True).select(*catalogue.columns)
    if "prefix" in out.columns:
        from shelfmark.functions.scalars import key_name, key_prefix

        out = out.withColumns({"prefix": key_prefix(F.col("key")), "name": key_name(F.col("key"))})
    return out


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] = ("id", "created_at_ns")) -> DataFrame:
    """existing with incoming's last row of each key put in; a row that was there keeps the columns of keep.

    Last is greatest in order, then in all columns. The result has existing's columns; those incoming
    lacks stay as they were, null in new rows.
    """
    given = [c for c in existing.columns if c in incoming.columns and c not in keys]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*given), F.struct(*order, *[F.to_json(F.struct(c)) for c in given])).alias("_in"))
    joined = existing.withColumn("_was", F.lit(True)).join(last, list(keys), "full")
    out = {}
    for c in given:
        new = F.col(f"_in.{c}")
        out[c] = F.when(F.col("_in").isNull() | (F.col("_was").isNotNull() if c in keep else F.lit(False)), F.col(c)).otherwise(new)
    return joined.withColumns(out).select(*existing.columns)


def deleted(existing: DataFrame, keys: DataFrame, on: Sequence[str] = ("bucket", "key")) -> DataFrame:
    """existing without the rows of keys."""
    return existing.join(keys.select(*on).distinct(), list(on), "left_anti")


#: The most keys a bulk deletion takes.
BULK_LIMIT = 1000


def bulk_delete(existing: DataFrame, keys: DataFrame, limit: Optional[int] = None) -> DataFrame:
    """(bucket, key, existed) for each distinct key asked to go; what did not exist counts as deleted. More than limit is refused."""
    asked = keys.select("bucket", "key").distinct()
    if limit is not None and asked.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} keys")
    there = existing.select("bucket", "key").distinct().withColumn("existed", F.lit(True))
    return asked.join(there, ["bucket", "key"], "left").fillna(False, ["existed"])


def renames(existing: DataFrame, moves: DataFrame, overwrite: bool = False) -> DataFrame:
    """(bucket, old_key, new_key, outcome) of each move asked for: moved, no_such_key, or exists where the new key is taken."""
    there = existing.select("bucket", "key").distinct()
    a = there.select("bucket", F.col("key").alias("old_key"), F.lit(True).alias("_from"))
    b = there.select("bucket", F.col("key").alias("new_key"), F.lit(True).alias("_to"))
    asked = moves.select("bucket", "old_key", "new_key").distinct()
    taken = F.lit(False) if overwrite else F.col("_to").isNotNull() & (F.col("old_key") != F.col("new_key"))
    outcome = F.when(F.col("_from").isNull(), "no_such_key").when(taken, "exists").otherwise("moved")
    return asked.join(a, ["bucket", "old_key"], "left").join(b, ["bucket", "new_key"], "left").select("bucket", "old_key", "new_key", outcome.alias("outcome"))


def renamed(existing: DataFrame, moves: DataFrame, now_ns: int, overwrite: bool = False) -> DataFrame:
    """existing with the moves that can be made made: key, prefix, name and last_modified change, all else stays."""
    from shelfmark.functions.scalars import key_name, key_prefix

    done = renames(existing, moves, overwrite).filter("outcome = 'moved'").select("bucket", F.col("old_key").alias("key"), F.col("new_key").alias("_new"))
    if overwrite:
        lost = done.filter(F.col("key") != F.col("_new")).select("bucket", F.col("_new").alias("key"))
        existing = existing.join(lost, ["bucket", "key"], "left_anti")
    out = existing.join(done, ["bucket", "key"], "left")
    moved = F.col("_new").isNotNull()
    return out.withColumns({
        "prefix": F.when(moved, key_prefix(F.col("_new"))).otherwise(F.col("prefix")),
        "name": F.when(moved, key_name(F.col("_new"))).otherwise(F.col("name")),
        "last_modified_ns": F.when(moved, F.lit(now_ns)).otherwise(F.col("last_modified_ns")),
        "key": F.coalesce("_new", "key"),
    }).select(*existing.columns)


def enriched(existing: DataFrame, updates: DataFrame, level: int, on: Sequence[str] = ("bucket", "key")) -> DataFrame:
    """existing with the columns of updates put in where a row is still below the level, which it then has.

    Levels only rise here. updates has one row per key at most.
    """
    given = [c for c in updates.columns if c not in on]
    up = updates.select(*on, F.struct(*given).alias("_up"))
    joined = existing.join(up, list(on), "left")
    use = F.col("_up").isNotNull() & (F.col("scan_level") < level)
    out = {c: F.when(use, F.col(f"_up.{c}")).otherwise(F.col(c)) for c in given}
    out["scan_level"] = F.when(use, F.lit(level)).otherwise(F.col("scan_level")).cast("int")
    return joined.withColumns(out).select(*existing.columns)


def reset(existing: DataFrame, keys: DataFrame, level: int, on: Sequence[str] = ("bucket", "key")) -> DataFrame:
    """existing with the level of the rows of keys lowered to level where it is higher."""
    marked = existing.join(keys.select(*on).distinct().withColumn("_mark", F.lit(True)), list(on), "left")
    return marked.withColumn("scan_level", F.when(F.col("_mark"), F.least("scan_level", F.lit(level))).otherwise(F.col("scan_level")).cast("int")).select(*existing.columns)


def copies(existing: DataFrame, requests: DataFrame, now_ns: int) -> DataFrame:
    """Rows that copying makes: of requests(bucket, key, to_bucket, to_key), the source's row under the new key, with a new id and time."""
    from shelfmark.functions.scalars import key_name, key_prefix

    made = existing.join(requests.select("bucket", "key", "to_bucket", "to_key").distinct(), ["bucket", "key"])
    return made.withColumns({
        "bucket": F.col("to_bucket"), "key": F.col("to_key"), "prefix": key_prefix(F.col("to_key")), "name": key_name(F.col("to_key")),
        "id": new_id(F.col("to_bucket"), F.col("to_key"), F.lit(now_ns)), "created_at_ns": F.lit(now_ns), "last_modified_ns": F.lit(now_ns),
    }).select(*existing.columns)


def merge_plan(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """(winner_id, loser_id, outcome) of merging losers into winners: what may be deleted, and why not.

    requests has winner_id and loser_id. Outcomes: delete, same_object where the winner is among the
    losers, no_such_key where either is gone, scan_pending where either has no hash, mismatch.
    """
    rows = objects.select("id", "checksum_sha256").dropDuplicates(["id"])
    w = rows.select(F.col("id").alias("winner_id"), F.col("checksum_sha256").alias("_w"), F.lit(True).alias("_hw"))
    x = rows.select(F.col("id").alias("loser_id"), F.col("checksum_sha256").alias("_l"), F.lit(True).alias("_hl"))
    outcome = (
        F.when(F.col("winner_id") == F.col("loser_id"), "same_object")
        .when(F.col("_hw").isNull() | F.col("_hl").isNull(), "no_such_key")
        .when(F.col("_w").isNull() | F.col("_l").isNull(), "scan_pending")
        .when(F.col("_w") != F.col("_l"), "mismatch")
        .otherwise("delete")
    )
    return requests.select("winner_id", "loser_id").distinct().join(w, "winner_id", "left").join(x, "loser_id", "left").select("winner_id", "loser_id", outcome.alias("outcome"))


def stale_directories(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket, prefix) of directories in which a file came, went, or changed its hash; a change of size alone counts for nothing."""
    a = before.select("bucket", "prefix", "name", F.col("checksum_sha256").alias("h"), F.lit(True).alias("_a"))
    b = after.select("bucket", "prefix", "name", F.col("checksum_sha256").alias("g"), F.lit(True).alias("_b"))
    differs = F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("h").eqNullSafe(F.col("g"))
    return a.join(b, ["bucket", "prefix", "name"], "full").filter(differs).select("bucket", "prefix").distinct()
