"""Ranks within groups of any size, without one task holding a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialise


def columns_named(df: DataFrame, name: str) -> str:
    """name, or name with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def last_at_most(values: Column, x: Column, longest: int) -> Column:
    """The place of the last of sorted values that is at most x, where the first one is; by halving steps, of which longest needs so many."""
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(max(1, (longest - 1).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(values, at + step) <= x, F.lit(False)), at + step).otherwise(at))


def with_group_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str = "rank", tasks: int | None = None) -> DataFrame:
    """df with rank 0, 1, 2, ... of each row within its group, in the order of the order columns.

    The rows are range-partitioned by group and order, so a group that holds most rows spreads over
    as many partitions as its share. A row's rank is its place in its partition's piece of the group
    plus the pieces before it; of those there are at most as many as partitions.

    Nulls group together and sort first. Rows equal in group and order get consecutive ranks in an
    unspecified order, fixed by the one written copy that both steps read. No rows give no rows. A
    column of df already called rank is replaced.
    """
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.drop(rank)
    piece, before = columns_named(df, "piece"), columns_named(df, "before")
    by: list[Column] = [F.col(f"`{c}`") for c in (*group, *order)]
    placed = materialise(df.repartitionByRange(tasks, *by).withColumn(piece, F.spark_partition_id()))
    groups = [F.col(f"`{c}`") for c in group]
    pieces = placed.groupBy(*groups, F.col(piece)).agg(F.count(F.lit(1)).alias(before))
    running = Window.partitionBy(*groups).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn(before, F.coalesce(F.sum(before).over(running), F.lit(0)))
    inside = Window.partitionBy(*groups, F.col(piece)).orderBy(*[F.col(f"`{c}`") for c in order])
    local = placed.withColumn(rank, (F.row_number().over(inside) - 1).cast("long"))
    left, right = local.alias("l"), pieces.alias("r")
    same = F.col(f"l.{piece}") == F.col(f"r.{piece}")
    for c in group:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return left.join(right, same).select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col(f"l.`{rank}`") + F.col(f"r.{before}")).alias(rank))
