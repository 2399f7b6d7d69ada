"""Streams of file changes and object events, applied batch by batch.

All jobs are foreachBatch sinks over replayable sources with a checkpoint. A batch that is run again
does the same work: tables are versioned by batch, and log rows carry keys that repeat.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from datetime import datetime
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions.scalars import key_name, key_prefix
from shelfmark.operators.catalogue import new_id
from shelfmark.operators.matching import deliveries
from shelfmark.operators.multipart import abandoned, current_parts, without
from shelfmark.operators.skew import semi_join
from shelfmark.operators.stats import byte_budget
from shelfmark.session import materialise
from shelfmark.sources.store import Versions


def last_change(batch: DataFrame) -> DataFrame:
    """The last change of each file in a batch; a deletion yields to a change of the same moment."""
    order = F.struct("ts", (F.col("op") == "changed").alias("kept")) if "ts" in batch.columns else F.struct((F.col("op") == "changed").alias("kept"))
    rest = [c for c in batch.columns if c not in ("bucket", "key")]
    return batch.groupBy("bucket", "key").agg(F.max_by(F.struct(*rest), order).alias("_c")).select("bucket", "key", "_c.*")


def applied(catalogue: DataFrame, batch: DataFrame, now_ns: int) -> DataFrame:
    """The catalogue after a batch of (bucket, key, op, size, mtime_ns) changes.

    A file whose size and time are as known is a false alarm. Otherwise it goes back to level 1 without
    digests; one that is not known is put in at level 1; a deleted one goes.
    """
    change = last_change(batch).select("bucket", "key", F.struct("op", "size", "mtime_ns").alias("_c"))
    both = catalogue.withColumn("_was", F.lit(True)).join(change, ["bucket", "key"], "full")
    both = both.filter(F.col("_c").isNull() | (F.col("_c.op") != "deleted"))
    same = F.col("_was").isNotNull() & F.col("_c.size").eqNullSafe(F.col("size")) & F.col("_c.mtime_ns").eqNullSafe(F.col("file_mtime_ns"))
    fresh = F.col("_c").isNotNull() & ~same
    new = fresh & F.col("_was").isNull()
    out = {
        "size": F.when(fresh, F.col("_c.size")).otherwise(F.col("size")),
        "file_mtime_ns": F.when(fresh, F.col("_c.mtime_ns")).otherwise(F.col("file_mtime_ns")),
        "scan_level": F.when(fresh, F.lit(1)).otherwise(F.col("scan_level")).cast("int"),
        "last_modified_ns": F.when(fresh, F.lit(now_ns)).otherwise(F.col("last_modified_ns")),
        "created_at_ns": F.when(new, F.lit(now_ns)).otherwise(F.col("created_at_ns")),
        "id": F.when(new, new_id(F.col("bucket"), F.col("key"), F.lit(now_ns))).otherwise(F.col("id")),
        "prefix": F.coalesce("prefix", key_prefix(F.col("key"))),
        "name": F.coalesce("name", key_name(F.col("key"))),
    }
    out |= {c: F.when(~fresh, F.col(c)) for c in ("etag", "checksum_sha256", "checksum_sha1", "checksum_crc32", "checksum_crc32c")}
    return both.withColumns({c: e for c, e in out.items() if c in catalogue.columns}).select(*catalogue.columns)


def follow(changes: DataFrame, table: Versions, checkpoint: str, interval: Optional[str] = None) -> StreamingQuery:
    """Keep a versioned catalogue current with a stream of file changes: at an interval, or once with what there is.

    A batch reads the rows of its files and writes those that change.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch = materialise(batch)
            names = materialise(batch.select("bucket", "key").distinct())
            held = materialise(semi_join(table.read(), names, ["bucket", "key"]))
            after = materialise(applied(held, batch, time.time_ns()))
            same = held.select("bucket", "key", "scan_level", "size", "file_mtime_ns", "last_modified_ns")
            table.amend(after.join(same, same.columns, "left_anti"), held.join(after, ["bucket", "key"], "left_anti"))

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


#: Waits between the attempts of a delivery, in seconds.
RETRY_AFTER = (1.0, 5.0)

#: How long an attempt may take, in seconds.
SEND_LIMIT = 30.0

LOG = "id string, webhook_id string, event_type string, object_key string, delivered_at timestamp, attempts int, last_error string, status string"


def timed(send: Callable[[str, dict], None], url: str, event: dict, limit: float) -> None:
    """send(url, event), given up with a TimeoutError once it has taken longer than limit seconds."""
    failed: list[BaseException] = []

    def run() -> None:
        try:
            send(url, event)
        except BaseException as e:
            failed.append(e)

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(limit)
    if worker.is_alive():
        raise TimeoutError(f"no answer within {limit:g} s")
    if failed:
        raise failed[0]


def deliver(events: DataFrame, webhooks: DataFrame, send: Callable[[str, dict], None], log: str, checkpoint: str, waits: Sequence[float] = RETRY_AFTER, limit: float = SEND_LIMIT) -> StreamingQuery:
    """Send each event to the webhooks that match it, and log every attempt under log.

    send(url, event) raises if it fails; it runs in tasks, and an attempt fails after limit seconds. An attempt's log id names webhook, event and
    attempt, so rows of a repeated batch are known by it. A batch's rows replace those of its last run.
    """

    def attempt(rows):
        import pandas as pd

        for batch in rows:
            out = []
            for job in batch.to_dict("records"):
                for n, wait in enumerate((*waits, None), 1):
                    try:
                        timed(send, job["url"], job, limit)
                        error = None
                    except Exception as e:
                        error = str(e)
                    out.append((f"{job['webhook_id']}/{job['event_id']}/{n}", job["webhook_id"], "webhook", job["object_key"], pd.Timestamp.now(), 1, error, "failed" if error else "delivered"))
                    if error is None or wait is None:
                        break
                    time.sleep(wait)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    def run(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["event_id"])
        matched = deliveries(once, webhooks).select("webhook_id", "url", "event_id", "event_name", "object_key", F.col("event_time").cast("string").alias("event_time"))
        matched.mapInPandas(attempt, LOG).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_objects(events: DataFrame, table: Versions, checkpoint: str) -> StreamingQuery:
    """Keep the objects that exist current with a stream of (bucket, object_key, object_id, event_time, event_id, removed); a batch writes its own keys.

    Removed keys stay as rows, so a late event of an earlier time changes nothing; live() leaves them out.
    """

    def apply(batch: DataFrame, number: int) -> None:
        columns = ["bucket", "object_key", "event_time", "event_id", "object_id", "removed"]
        last = F.max(F.struct("event_time", "event_id", "object_id", "removed")).alias("_e")
        newest = lambda rows: rows.groupBy("bucket", "object_key").agg(last).select("bucket", "object_key", "_e.*")
        rows = materialise(newest(batch.select(*columns)))
        table.keys = ("bucket", "object_key")
        if table.current() is None:
            table.commit(rows)
        else:
            held = semi_join(table.read().select(*columns), rows, ["bucket", "object_key"])
            table.amend(newest(rows.unionByName(held)))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(table: Versions) -> DataFrame:
    """The objects that exist in a table of follow_objects."""
    return table.read().filter("not removed").select("bucket", "object_key", "object_id")


def pending_batches(read: Callable[[], DataFrame], level: int, step: Callable[[DataFrame], None], budget: int) -> int:
    """Call step with batch after batch of files below a level until none is left; how many there were.

    read gives the catalogue as it is now, and step raises the level of its batch there. Batches go through
    each bucket in listing order, so a file whose level step does not raise comes once and holds up none
    behind it. Files that come to lie before the place reached are for the next call.
    """
    done, reached = 0, None
    while True:
        files = read()
        if reached is not None:
            beyond = F.col("_reached").isNull() | (F.struct("prefix", "name") > F.col("_reached"))
            files = files.join(F.broadcast(reached), "bucket", "left").filter(beyond).drop("_reached")
        batch = materialise(byte_budget(files, level, budget))
        if batch.isEmpty():
            return done
        step(batch)
        done += 1
        last = batch.select("bucket", F.struct("prefix", "name").alias("_reached"))
        last = last if reached is None else last.unionByName(reached)
        reached = materialise(last.groupBy("bucket").agg(F.max("_reached").alias("_reached")))


def progress(query: StreamingQuery) -> dict:
    """Where a stream stands: its last batch, rows in it and per second, and whether it runs."""
    last = query.lastProgress
    known = {k: last[k] for k in ("batchId", "numInputRows", "processedRowsPerSecond")} if last else {}
    return {"running": query.isActive, "error": str(query.exception()) if query.exception() else None, **known}


def clean_uploads(uploads: Versions, parts: Versions, before: datetime) -> dict[str, int]:
    """Drop uploads begun before a moment, with their parts; how many, and the bytes they held."""
    gone = materialise(abandoned(uploads.read(), current_parts(parts.read()), before))
    report = gone.agg(F.count(F.lit(1)).alias("uploads"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().asDict()
    if report["uploads"]:
        left, rest = without(uploads.read(), parts.read(), gone)
        parts.commit(rest)
        uploads.commit(left)
    return report
