"""What changed between full snapshots of a listing.

Snapshots are kept in ranges of scope and key with fixed bounds, each range sorted, so that a new one is
compared with the one before it by merging the two, range by range, and nothing else is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.ranking import last_at_most, with_group_rank
from shelfmark.session import materialise, shared_folder, small, temporary

#: Keys from which the bounds of a range are taken.
KEYS_PER_RANGE = 64


def bounds_of(rows: DataFrame, ranges: int) -> list[tuple]:
    """Lower bounds of ranges of (s, k) with about as many distinct keys each; the first one is below all.

    All keys fall by their hash into so many buckets for each range, and the key of the smallest hash in
    each bucket, found map-side, is all that the driver gets. What the bounds are decides how even the
    ranges are, never what is found.
    """
    h = F.xxhash64("s", "k")
    one = rows.select("s", "k").groupBy(F.pmod(h, F.lit(ranges * KEYS_PER_RANGE)).alias("bucket")).agg(F.min_by(F.struct("s", "k"), F.struct(h, "s", "k")).alias("x"))
    keys = sorted((r.s, r.k) for r in one.select("x.*").collect())
    inner = sorted(set(keys[len(keys) // ranges or 1 :: max(1, len(keys) // ranges)]))
    return inner[: ranges - 1]


class KeptSnapshots:
    """Snapshots of scopes, each written once in ranges that all of them share, sorted by scope and key.

    A load may hold several snapshots, and later loads may add rows to one. The bounds of the ranges come
    from the first load and stay; all files go through Spark and Hadoop's file systems.
    """

    def __init__(self, spark: SparkSession, path: str, compared: Sequence[str], identity: Sequence[str], ranges: Optional[int] = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.compared, self.identity = list(compared), list(identity)
        self.values = list(dict.fromkeys([*compared, *identity]))
        self.ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _settings(self) -> Optional[dict]:
        """Schema and bounds, once there was a load."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ranges.json")
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/ranges.json", wholetext=True).first()[0])

    def _range(self, bounds: list, schema: T.StructType) -> Column:
        """The number of the range of (s, k), found by halving."""
        if not bounds:
            return F.lit(0)
        kind = lambda c, v: F.lit(v).cast(schema[c].dataType)
        lows = F.array(*[F.struct(kind("s", s).alias("s"), kind("k", k).alias("k")) for s, k in bounds])
        here = F.struct("s", "k")
        return F.when(here < lows[0], 0).otherwise(last_at_most(lows, here, len(bounds)) + 1)

    def add(self, df: DataFrame, scope: str, snapshot: str, key: str, loaded: Optional[str] = None) -> None:
        """Keep the rows of a load; those without a scope, snapshot or key are left out."""
        rows = df.select(
            F.col(scope).alias("s"), F.col(snapshot).alias("n"), F.col(key).alias("k"),
            F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(self.values)]).alias("v"),
            (F.col(loaded) if loaded else F.lit(0)).alias("at"),
        ).dropna(subset=["s", "n", "k"])
        settings = self._settings()
        if settings is None:
            settings = {"schema": rows.schema.jsonValue(), "ranges": self.ranges, "bounds": bounds_of(rows, self.ranges)}
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
            place = hadoop.Path(f"{self.path}/ranges.json")
            out = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
            out.write(bytearray(json.dumps(settings, default=str).encode()))
            out.close()
        placed = rows.withColumn("range", self._range(settings["bounds"], rows.schema)).repartitionById(settings["ranges"], "range")
        load = uuid.uuid4().hex
        placed.sortWithinPartitions("n", "s", "k").write.partitionBy("n").parquet(f"{self.path}/rows/load={load}")
        kept = self._rows("rows", settings, load)
        kept.select("s", "n").distinct().write.parquet(f"{self.path}/delivered/load={load}")

    def _rows(self, what: str, settings: dict, load: str = "*") -> DataFrame:
        schema = T.StructType.fromJson(settings["schema"])
        schema = T.StructType([schema["s"], schema["n"]]) if what == "delivered" else T.StructType([*schema, T.StructField("range", T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}/load={load}").drop("load")

    def steps(self) -> DataFrame:
        """(s, before, after): consecutive snapshots of each scope."""
        delivered = self._rows("delivered", self._settings() or {}).groupBy("s").agg(F.array_sort(F.collect_set("n")).alias("all"))
        pairs = F.arrays_zip(F.expr("slice(all, 1, size(all) - 1)").alias("before"), F.expr("slice(all, 2, size(all))").alias("after"))
        return delivered.filter(F.size("all") > 1).select("s", F.explode(pairs).alias("p")).select("s", "p.before", "p.after")

    def merged(self, steps: DataFrame) -> DataFrame:
        """(s, n, kind, k, i0, i1, ...): added, removed and changed keys in these steps, with their identity.

        The sides of all steps are merged range by range: both are sorted by scope, snapshot and key, and
        one pointer runs along each, as Spark's sort-merge join does. A key listed several times in a
        snapshot counts once: the row loaded last, then the greatest values.
        """
        settings = self._settings()
        steps = small(steps)
        numbers = sorted({n for r in steps.select("before", "after").distinct().collect() for n in r})
        kept = self._rows("rows", settings).filter(F.col("n").isin(numbers)).repartitionById(settings["ranges"], "range")
        once = kept.groupBy("range", "s", "n", "k").agg(F.max(F.struct("at", "v")).alias("x"))
        side = lambda by, to, name: once.withColumnRenamed("n", by).join(steps, ["s", by]).select("range", "s", F.col("after").alias("n"), "k", F.col("x.v").alias(name))
        both = side("before", "after", "old").join(side("after", "after", "new").hint("merge"), ["range", "s", "n", "k"], "full")
        differs = F.lit(False)
        for i, c in enumerate(self.values):
            if c in self.compared:
                differs = differs | ~F.col(f"old.v{i}").eqNullSafe(F.col(f"new.v{i}"))
        kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(differs, "changed")
        ids = [F.coalesce(F.col("new"), F.col("old"))[f"v{self.values.index(c)}"].alias(f"i{j}") for j, c in enumerate(self.identity)]
        return both.withColumn("kind", kind).filter("kind is not null").select("s", "n", "kind", "k", *ids)

    def changes(self, snapshots: Optional[Sequence] = None) -> DataFrame:
        """(s, n, change_kind, old_key, new_key): changes to each snapshot of each scope, or to those asked for, from the one delivered before.

        Only the snapshots compared are read. Removed and added keys with equal identity, all of it known,
        are moves. Where several qualify they pair one to one in bytewise key order. Their ranks come from
        range partitions as well, so an identity shared by most files, as where a file system numbers none,
        stays spread. The first snapshot of a scope gives no changes.
        """
        settings = self._settings()
        if settings is None:
            raise FileNotFoundError(f"{self.path} has no snapshot yet")
        steps = self.steps()
        steps = steps if snapshots is None else steps.filter(F.col("after").isin(list(snapshots)))
        found = materialise(self.merged(steps))
        ids = [f"i{j}" for j in range(len(self.identity))]
        known = F.lit(True)
        for i in ids:
            known = known & F.col(i).isNotNull()
        movable = found.filter((F.col("kind") != "changed") & known)
        ranked = with_group_rank(movable, ["s", "n", *ids, "kind"], ["k"], "rank", settings["ranges"])
        pair = ["s", "n", *ids, "rank"]
        gone = ranked.filter("kind = 'removed'").select(*pair, F.col("k").alias("old_key"))
        come = ranked.filter("kind = 'added'").select(*pair, F.col("k").alias("new_key"))
        moved = gone.join(come, pair, "full").select(
            "s", "n",
            F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").otherwise("moved").alias("change_kind"),
            F.coalesce("old_key", F.lit("")).alias("old_key"), F.coalesce("new_key", F.lit("")).alias("new_key"),
        )
        plain = found.filter((F.col("kind") == "changed") | ~known).select(
            "s", "n", F.col("kind").alias("change_kind"),
            F.when(F.col("kind") != "added", F.col("k")).otherwise("").alias("old_key"),
            F.when(F.col("kind") != "removed", F.col("k")).otherwise("").alias("new_key"),
        )
        return plain.unionByName(moved)


def snapshot_changes(df: DataFrame, scope: str, snapshot: str, key: str, compared: Sequence[str], identity: Sequence[str], loaded: str | None = None, tasks: int | None = None) -> DataFrame:
    """(scope, snapshot, change_kind, old_key, new_key): changes between each snapshot of a scope and the next delivered.

    For a table that holds all snapshots: they are kept in ranges for this once and compared as
    KeptSnapshots does. A key that skips the next delivered snapshot was removed there; one that was not
    in the last one was added; one in both is compared column by column, null equal to null. Rows without
    a scope, snapshot or key are left out. An empty table gives no changes. Other columns play no part.
    """
    kept = KeptSnapshots(df.sparkSession, temporary(df.sparkSession, f"{shared_folder(df.sparkSession)}/snapshots-{uuid.uuid4().hex}"), compared, identity, tasks)
    kept.add(df, scope, snapshot, key, loaded)
    return kept.changes().withColumnsRenamed({"s": scope, "n": snapshot})
