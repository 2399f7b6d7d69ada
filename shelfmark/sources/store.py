"""Versions of a table on shared storage: immutable Parquet folders, each whole once its marker file is there.

A version is a whole table, its base, and the changes made since, in folders of their own; reading puts
them together. So a change costs what it changes. Changes of like size are merged now and then, and all
of them go into a new base once they are a fourth of it, so that neither their number nor what a reader
has to put together grows with the number of changes made.

All files go through Hadoop's file systems, so a table may lie on any storage the cluster reads.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Changes are merged when so many of like size follow each other; sizes are alike up to this factor.
ALIKE = 8

#: Changes of so few rows are sent to all tasks when a version is read.
FEW_ROWS = 50_000


class Versions:
    """A table whose every change is a new version; one writer at a time.

    A version counts once its marker is written, which is the last step and holds the schema, so that
    versions without rows can be read. A version that was left unfinished is overwritten. keys name a
    row for amend; the last `keep` versions stay, older ones are deleted by whatever makes a new one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("bucket", "key"), keep: int = 3):
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), tuple(keys), keep

    def _place(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self) -> list[str]:
        fs, root = self._place()
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def versions(self) -> list[int]:
        """The numbers of the whole versions, oldest first."""
        return sorted(int(n[2:-5]) for n in self._names() if n.startswith("v=") and n.endswith(".json"))

    def current(self) -> Optional[int]:
        """The number of the current version, or None before the first."""
        return max(self.versions(), default=None)

    def _marker(self, version: Optional[int]) -> dict:
        """What a version is made of: schema, base and its rows, and [folder, rows] of each change."""
        version = self.current() if version is None else version
        if version is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        return json.loads(self.spark.read.text(f"{self.path}/v={version}.json", wholetext=True).first()[0])

    def _mark(self, version: int, marker: dict) -> int:
        fs, place = self._place(f"v={version}.json")
        out = fs.create(place, True)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        self.expire(self.keep)
        return version

    def _changes(self, schema: T.StructType, folders: Sequence[int]) -> DataFrame:
        """The last change of each row in some change folders, with _gone for those that were deleted."""
        kinds = T.StructType([*schema, T.StructField("_gone", T.BooleanType()), T.StructField("_no", T.LongType())])
        rows = self.spark.read.schema(kinds).parquet(*[f"{self.path}/d={n}" for n in folders])
        rest = [c for c in kinds.names if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_no").alias("_last"))
        return last.select(*[F.col(c) if c in self.keys else F.col(f"_last.{c}").alias(c) for c in kinds.names])

    def read(self, version: Optional[int] = None) -> DataFrame:
        """A version, by default the current one."""
        marker = self._marker(version)
        schema = T.StructType.fromJson(marker["schema"])
        base = self.spark.read.schema(schema).parquet(f"{self.path}/v={marker['base']}")
        if not marker["changes"]:
            return base
        changes = self._changes(schema, [n for n, _ in marker["changes"]])
        keys = changes.select(*self.keys)
        keys = F.broadcast(keys) if sum(rows for _, rows in marker["changes"]) <= FEW_ROWS else keys
        return base.join(keys, list(self.keys), "left_anti").unionByName(changes.filter("not _gone").select(*schema.names)).select(*schema.names)

    def note(self) -> Optional[int]:
        """The note of the current version."""
        return None if self.current() is None else self._marker(None).get("note")

    def commit(self, df: DataFrame, partition_by: Optional[str] = "bucket", note: Optional[int] = None) -> int:
        """Write df as the next version, as a whole, and make it current. df may read the version it replaces."""
        version = (self.current() or 0) + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by in df.columns else writer).parquet(f"{self.path}/v={version}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/v={version}").count()
        return self._mark(version, {"schema": df.schema.jsonValue(), "base": version, "rows": rows, "changes": [], "note": note})

    def _write(self, number: int, changed: DataFrame) -> int:
        changed.withColumn("_no", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/d={number}")
        return self.spark.read.parquet(f"{self.path}/d={number}").count()

    def amend(self, rows: DataFrame, gone: Optional[DataFrame] = None, note: Optional[int] = None) -> int:
        """Make a version in which rows replace those of their keys or are new, and those of the keys of gone are no more.

        rows has one row per key, and gone no key of rows. Nothing but these is written, now and then what
        was written by earlier changes too. Without any of them there is no new version.
        """
        marker = self._marker(None)
        schema, version = T.StructType.fromJson(marker["schema"]), (self.current() or 0) + 1
        changed = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema], F.lit(False).alias("_gone"))
        if gone is not None:
            changed = changed.unionByName(gone.select(*self.keys, F.lit(True).alias("_gone")).distinct(), allowMissingColumns=True)
        count = self._write(version, changed)
        if not count:
            fs, place = self._place(f"d={version}")
            fs.delete(place, True)
            return version - 1
        changes = [*marker["changes"], [version, count]]
        if sum(n for _, n in changes) * 4 > marker["rows"]:
            self._mark(version, {**marker, "changes": changes, "note": note})
            return self.commit(self.read(), note=note)
        tier = lambda n: int(math.log(max(n, 1), ALIKE))
        while len(changes) >= ALIKE and len({tier(n) for _, n in changes[-ALIKE:]}) == 1:
            kinds = T.StructType([*schema, T.StructField("_gone", T.BooleanType())])
            merged = self._changes(schema, [n for n, _ in changes[-ALIKE:]]).select(*kinds.names)
            version += 1
            changes = [*changes[:-ALIKE], [version, self._write(version, merged)]]
        return self._mark(version, {**marker, "changes": changes, "note": note})

    def changed_since(self, version: int) -> Optional[DataFrame]:
        """Keys of rows that may have changed after a version; None where that is not known, because all was written since."""
        marker = self._marker(None)
        if marker["base"] > version:
            return None
        schema = T.StructType.fromJson(marker["schema"])
        later = [n for n, _ in marker["changes"] if n > version]
        keys = self._changes(schema, later) if later else self.spark.createDataFrame([], schema)
        return keys.select(*self.keys)

    def expire(self, keep: int = 2) -> list[int]:
        """Delete all but the last `keep` versions, and the folders none of those needs; the versions' numbers."""
        gone = self.versions()[:-keep] if keep else self.versions()
        for version in gone:
            fs, place = self._place(f"v={version}.json")
            fs.delete(place, True)
        left = [self._marker(v) for v in self.versions()] if gone else []
        if gone:
            needed = {f"v={m['base']}" for m in left} | {f"d={n}" for m in left for n, _ in m["changes"]}
            newest = max(self.versions(), default=0)
            for name in self._names():
                if name[:2] in ("v=", "d=") and not name.endswith(".json") and name not in needed and int(name[2:]) <= newest:
                    fs, place = self._place(name)
                    fs.delete(place, True)
        return gone
