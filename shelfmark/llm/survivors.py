"""The best record of each group of duplicates, and for each field the member that gives its value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialise

#: So many of the largest groups that are too large are cut out before any row is moved.
LARGEST = 2000


def candidate_rows(df: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """Rows of df without those of the largest groups that surely have more than `most` members.

    One map-side aggregation counts rows by group and marks members in bitmaps by their hash: more marks
    than `most` mean more members than that. Of such groups the largest, of which a share of 1/LARGEST of
    all rows is always one, are cut out by a broadcast anti-join. What is left has no group that is both
    crowded and large; a group whose rows repeat a few members shrinks to them map-side.
    """
    lanes, hashed = most // 32 + 1, F.xxhash64(member)
    slot = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hashed, F.lit(64)).cast("int"))
    lane = F.pmod(F.floor(hashed / 64), F.lit(lanes))
    marks = sum((F.coalesce(F.bit_count(F.bit_or(F.when(lane == n, slot))), F.lit(0)) for n in range(lanes)), F.lit(0))
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), marks.alias("marks"))
    crowded = materialise(counted.filter(F.col("marks") > most).orderBy(F.col("rows").desc(), group).limit(LARGEST).select(group))
    return df.join(F.broadcast(crowded), group, "left_anti")


def _number(c: Column, kind: str) -> Column:
    """A moment as a number that keeps its order."""
    return F.unix_micros(c) if kind.startswith("timestamp") else F.unix_date(c) if kind == "date" else c


def survivors(df: DataFrame, group: str, member: str, completeness: Sequence[str], recency: str, key: str, fields: Sequence[str], trusted: Column, known: Mapping[str, Column], least: int = 2, most: Optional[int] = None) -> DataFrame:
    """(group, winner, field_name, donor): the surviving member of each group, and where each field's value comes from.

    Members rank by trust, by the number of known values among completeness, by recency with unknown
    last, and by the bytewise smallest key; the top one of a window over the group wins. A field's donor
    is the winner if it knows the value, else the first member that does by recency and key. A field no
    member knows has no row.

    Groups may be of any size: each task keeps its own top row and first members of a group before
    anything is shuffled by group, so one that has most rows sends few.

    known gives, for each column of completeness and fields, the value or null if it says nothing. Groups
    are those of at least `least` distinct members, and, if that is asked for, at most `most`; a null
    group or member belongs to none. Repeated rows of a member count once: the row that ranks first, key
    included. Null keys come before others. Ties left after the key fall to the smallest member. Empty
    tables give no rows. Extra columns play no part. recency is a number, a date or a timestamp.
    """
    names = list(dict.fromkeys([*completeness, *fields]))
    full = reduce(lambda a, b: a + b, [known[c].isNotNull().cast("int") for c in completeness])
    at = _number(F.col(recency), df.schema[recency].dataType.simpleString())
    flags = [known[c].isNotNull().alias(f"has{n}") for n, c in enumerate(names)]
    order = F.struct((~trusted).alias("plain"), (-full).alias("gaps"), at.isNull().alias("undated"), (-at).alias("age"), F.col(key).alias("k"), *flags)
    rows = df.select(F.col(group).alias("g"), F.col(member).alias("m"), order.alias("o")).dropna(subset=["g", "m"])
    rows = rows if most is None else candidate_rows(rows, "g", "m", most)
    # a member's repeats meet by group and member first, which spreads a member that is repeated without end
    once = materialise(rows.groupBy("g", "m").agg(F.min("o").alias("o")))
    recent = F.struct("o.undated", "o.age", "o.k", "m")
    kept = [n for n, c in enumerate(names) if c in fields]
    firsts = [F.min(F.when(F.col(f"o.has{n}"), recent)).alias(f"first{n}") for n in kept]
    groups = once.groupBy("g").agg(F.count(F.lit(1)).alias("members"), *firsts)
    groups = groups.filter((F.col("members") >= least) & (F.lit(True) if most is None else F.col("members") <= most))
    top = Window.partitionBy("g").orderBy(*[f"o.{c}" for c in ("plain", "gaps", "undated", "age", "k")], "m")
    winners = once.withColumn("turn", F.row_number().over(top)).filter("turn = 1").select("g", F.col("m").alias("winner"), "o")
    each = F.array(*[F.struct(F.lit(names[n]).alias("field_name"), F.when(F.col(f"o.has{n}"), F.col("winner")).otherwise(F.col(f"first{n}.m")).alias("donor")) for n in kept])
    chosen = winners.join(groups, "g").select(F.col("g").alias(group), "winner", F.explode(each).alias("f"))
    return chosen.select(group, "winner", "f.field_name", "f.donor").filter("donor is not null")
