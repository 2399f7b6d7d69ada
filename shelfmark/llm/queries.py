"""Queries of the operators on copies and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.values import canonical_uuid, digest32, epoch_ns, known_map, known_text
from shelfmark.llm.leaks import leaks
from shelfmark.llm.lookalikes import canonical_texts, look_classes, look_pairs, looks, searched
from shelfmark.llm.packing import containers, measured
from shelfmark.llm.survivors import survivors
from shelfmark.session import materialise, small
from shelfmark.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The winner of each group of equal contents, and for each field the member whose value is kept."""
    named = table(spark, folder, "merge_results").select(canonical_uuid(F.col("winner_object_id")).alias("id")).dropna().distinct().withColumn("named", F.lit(True))
    objects = table(spark, folder, "objects").select(
        digest32(F.col("checksum_sha256")).alias("content"), canonical_uuid(F.col("id")).alias("id"), "key", "size",
        epoch_ns(F.col("file_mtime_ns")).alias("file_mtime_ns"), "etag", "checksum_sha1", "content_type", "metadata",
    )
    rows = objects.join(small(named), "id", "left")
    known = {c: known_text(F.col(c)) for c in ("etag", "checksum_sha1", "content_type")}
    known |= {"size": F.col("size"), "file_mtime_ns": F.col("file_mtime_ns"), "metadata": known_map(F.col("metadata"))}
    found = survivors(
        rows, "content", "id", ["size", "file_mtime_ns", "etag", "checksum_sha1", "content_type", "metadata"], "file_mtime_ns", "key",
        ["content_type", "etag", "metadata", "checksum_sha1"], F.coalesce("named", F.lit(False)), known, most=20,
    )
    return found.select(F.col("winner").alias("winner_object_id"), "field_name", F.col("donor").alias("donor_object_id"))


def p6_containers(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """The container of each document, or of each piece of one that is too long, for each capacity."""
    items = measured(table(spark, folder, "documents"), "doc_id", "text", tokenizer)
    return containers(items, "doc_id", "tokens", table(spark, folder, "pack_capacities"), "capacity_id", "capacity_tokens")


def p6_fill(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Containers of each capacity, the tokens in them, and the fullest one's."""
    each = p6_containers(spark, folder, tokenizer).groupBy("capacity_id", "container").agg(F.sum("piece_length").alias("held"))
    return each.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("held").alias("tokens"), F.max("held").alias("fullest"))


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of documents measured in bytes: whether all are placed, none too much in a container, and few containers more than must be."""
    items = table(spark, folder, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    capacities = table(spark, folder, "pack_capacities")
    found = materialise(containers(items, "doc_id", "bytes", capacities, "capacity_id", "capacity_tokens"))
    boxes = found.groupBy("capacity_id", "container").agg(F.sum("piece_length").alias("held"))
    boxes = boxes.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens").distinct()), "capacity_id")
    least = F.ceil(F.sum("held") / F.first("capacity_tokens"))
    boxes = boxes.groupBy("capacity_id").agg(F.sum("held").alias("bytes"), F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"), (F.count(F.lit(1)) <= least * 11 / 9 + 1).alias("within_bound"))
    placed = found.groupBy("capacity_id", "doc_id").agg(F.count(F.lit(1))).groupBy("capacity_id").agg(F.count(F.lit(1)).alias("documents"))
    every = items.count()
    return boxes.join(placed, "capacity_id").select("capacity_id", "documents", "bytes", "overfull", (F.lit(every) - F.col("documents")).alias("unplaced"), "within_bound")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item, with the item."""
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation items that leaked, with the number of documents that hold a passage."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with different texts that look the same."""
    return look_pairs(searched(table(spark, folder, "documents"), "doc_id", "text"), "doc_id_a", "doc_id_b")


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """For each document the smallest id that looks the same, and how many spellings that look has."""
    found = look_classes(looks(table(spark, folder, "documents"), "doc_id", "text"))
    return found.select(F.col("item").alias("doc_id"), F.col("class_item").alias("class_id"), "spellings")


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each document in the form all texts share that look like it."""
    return canonical_texts(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("text", "form")


QUERIES = {f.__name__: f for f in (p3_found, p6_containers, p6_fill, p6_check, p7_found, p7_items, p8_found, p8_classes, p8_texts)}
