"""Tags of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits: tags of an object, bytes of a key, bytes of a value.
MOST_TAGS, KEY_BYTES, VALUE_BYTES = 10, 128, 256


def tags_of(objects: DataFrame, tags: DataFrame) -> DataFrame:
    """(bucket, object_key, tag, value) of the tags of objects that exist."""
    rows = objects.select("bucket", F.col("id").alias("object_id"), F.col("key").alias("object_key"))
    return rows.join(tags.select("bucket", "object_id", F.col("key").alias("tag"), "value"), ["bucket", "object_id"]).drop("object_id")


def tag_problems(objects: DataFrame, tags: DataFrame) -> DataFrame:
    """(bucket, object_id, problem) of objects whose tags break a limit, or that do not exist."""
    there = objects.select("bucket", F.col("id").alias("object_id"), F.lit(True).alias("_there")).dropDuplicates(["bucket", "object_id"])
    sums = tags.groupBy("bucket", "object_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("key")).alias("k"), F.max(F.octet_length("value")).alias("v"))
    problem = (
        F.when(F.col("_there").isNull(), "no_such_object").when(F.col("n") > MOST_TAGS, "too_many_tags")
        .when(F.col("k") > KEY_BYTES, "key_too_long").when(F.col("v") > VALUE_BYTES, "value_too_long")
    )
    return sums.join(there, ["bucket", "object_id"], "left").select("bucket", "object_id", problem.alias("problem")).filter("problem is not null")


def replaced(tags: DataFrame, given: DataFrame) -> DataFrame:
    """tags with all those of each object of given replaced by given's."""
    return tags.join(given.select("bucket", "object_id").distinct(), ["bucket", "object_id"], "left_anti").unionByName(given.select(*tags.columns))


def cleared(tags: DataFrame, gone: DataFrame) -> DataFrame:
    """tags without those of the objects of gone(bucket, object_id), as when an object is deleted."""
    return tags.join(gone.select("bucket", "object_id").distinct(), ["bucket", "object_id"], "left_anti")
