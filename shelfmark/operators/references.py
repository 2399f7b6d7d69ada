"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.values import month_of, month_text
from shelfmark.operators.skew import FEW_KEYS, semi_join
from shelfmark.session import materialise


@dataclass
class Reference:
    """A column of a child table that holds keys of a parent table.

    child_id and key are of the child, parent_key of the parent; keys are compared as text. scope and
    parent_scope must be equal too where given. Times are timestamps: at of the child, recorded and deleted of the
    parent.
    """

    child_table: str
    children: DataFrame
    child_id: Column
    key: Column
    at: Column
    parent_table: str
    parents: DataFrame
    parent_key: Column
    recorded: Column
    deleted: Column
    scope: Optional[Column] = None
    parent_scope: Optional[Column] = None


FOREVER = 2**31 - 1


def _children(r: Reference) -> DataFrame:
    scope = r.scope if r.scope is not None else F.lit("")
    return r.children.select(
        F.lit(r.child_table).alias("child_table"),
        F.lit(r.parent_table).alias("parent_table"),
        F.coalesce(scope.cast("string"), F.lit("")).alias("scope"),
        r.key.cast("string").alias("key"),
        month_of(r.at).alias("month"),
        r.child_id.cast("string").alias("child_id"),
    ).dropna(subset=["key", "month"])


def _lives(r: Reference) -> DataFrame:
    """Months at whose end a parent lives: from that of its arrival to the last before that of its deletion.

    It was recorded before the end of the month it arrived in. It is still living at the end of a month
    if it was deleted at or after that end, which is in a later month.
    """
    scope = r.parent_scope if r.parent_scope is not None else F.lit("")
    return r.parents.select(
        F.lit(r.parent_table).alias("parent_table"),
        F.coalesce(scope.cast("string"), F.lit("")).alias("scope"),
        r.parent_key.cast("string").alias("key"),
        month_of(r.recorded).alias("since"),
        F.when(r.deleted.isNull(), F.lit(FOREVER)).otherwise(month_of(r.deleted) - 1).alias("until"),
    ).filter("key is not null and since is not null and until >= since")


def orphan_keys(references: Sequence[Reference]) -> DataFrame:
    """(child_table, parent_table, scope, key, month, rows): keys referred to in a month with no living target at its end.

    Parents and children become one long table, tagged, and meet in one aggregation by parent table,
    scope and key; there is no join. Children are counted by key and month before, map-side, so a key
    that most rows refer to is a few rows here. What a group keeps is bounded by the months: counts by
    month, and distinct spans of months.
    """
    counted = reduce(DataFrame.unionByName, [_children(r) for r in references]).groupBy("child_table", "parent_table", "scope", "key", "month").agg(F.count(F.lit(1)).alias("rows"))
    lives = reduce(DataFrame.unionByName, {r.parent_table: _lives(r) for r in references}.values())
    none = F.lit(None)
    long = counted.withColumns({"since": none.cast("int"), "until": none.cast("int")}).unionByName(
        lives.withColumns({"child_table": none.cast("string"), "month": none.cast("int"), "rows": none.cast("long")})
    )
    grouped = long.groupBy("parent_table", "scope", "key").agg(
        F.collect_list(F.when(F.col("month").isNotNull(), F.struct("child_table", "month", "rows"))).alias("refs"),
        F.collect_set(F.when(F.col("since").isNotNull(), F.struct("since", "until"))).alias("lives"),
    )
    lone = F.filter("refs", lambda c: ~F.exists("lives", lambda p: (p.since <= c.month) & (c.month <= p.until)))
    return grouped.select("parent_table", "scope", "key", F.explode(lone).alias("r")).select("r.child_table", "parent_table", "scope", "key", "r.month", "r.rows")


def orphan_report(references: Sequence[Reference]) -> DataFrame:
    """(child_table, parent_table, period_month, keys, references) of references without a living target.

    A reference is judged at the end of the month of its time. Null keys refer to nothing and are no
    orphans; references without a time belong to no period and are left out, as are parents that never
    arrived (recorded null). Repeated child rows count each; repeated parent rows change nothing. Empty
    children give no rows; with empty parents all references are orphans.
    """
    return (
        orphan_keys(references)
        .groupBy("child_table", "parent_table", "month")
        .agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("references"))
        .select("child_table", "parent_table", month_text(F.col("month")).alias("period_month"), "keys", "references")
    )


def orphans(references: Sequence[Reference], few: int = FEW_KEYS) -> DataFrame:
    """Distinct (child_table, child_id, period_month) of the references orphan_keys finds.

    Children meet their orphan keys again. Those are counted: up to `few` are sent to the tasks, and
    children stay where they are read; beyond that the join splits keys with many children over tasks.
    """
    children = reduce(DataFrame.unionByName, [_children(r) for r in references]).drop("parent_table")
    on = ["child_table", "scope", "key", "month"]
    lost = materialise(orphan_keys(references).select(*on))
    found = semi_join(children, lost, on, few)
    return found.select("child_table", "child_id", month_text(F.col("month")).alias("period_month")).distinct()
