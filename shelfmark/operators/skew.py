"""Per-key results when a handful of keys holds most rows: fragment-replicate by load.

The plan is made from estimated loads. One pass counts all rows and keeps sketches of the most frequent
keys in each task, one for each of a fixed number of groups of keys; sketches of a group merge, so the
driver gets, from each group, the keys that may hold a quarter of a task's fair share, however large
the data. The load of a key is known
to a hundredth of that share or so. All other keys hash into bins, a fixed number per task, which share
the rest alike. The driver packs bins and shards of large keys onto tasks, largest first, each onto the
least loaded task.

Rows then go straight to their task's partition. A join's other side goes to the same partitions,
rows of split keys to every task that has a shard of theirs, all others to one. An estimate that is
off makes a task longer, and changes no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.ranking import columns_named

BINS_PER_TASK = 32


@dataclass
class LoadPlan:
    """Where rows go. bins: the task of each bin. heavy: hashes of large keys, and the tasks of their shards."""

    tasks: int
    bins: list[int]
    heavy: list[tuple[int, list[int]]]
    loads: list[int]


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys])


def pack(loads: list[int], heavy: list[tuple[int, int, int]], tasks: int) -> LoadPlan:
    """Bins with these loads, and heavy keys as (key, bin, load), packed onto tasks; largest piece first.

    A heavy key is cut into shards of at most half a task's fair share.
    """
    rest = list(loads)
    for _, at, load in heavy:
        rest[at] -= load
    share = max(1, sum(loads) / tasks)
    pieces: list[tuple[float, int, int]] = [(-load, 0, at) for at, load in enumerate(rest)]
    shards: list[list[int]] = []
    for n, (_, _, load) in enumerate(heavy):
        parts = min(tasks, max(1, -int(-2 * load // share)))
        shards.append([])
        pieces += [(-load / parts, 1, n)] * parts
    heap = [(0.0, t) for t in range(tasks)]
    place = [0] * len(loads)
    for load, kind, n in sorted(pieces):
        held, task = heapq.heappop(heap)
        if kind:
            shards[n].append(task)
        else:
            place[n] = task
        heapq.heappush(heap, (held - load, task))
    return LoadPlan(tasks, place, [(key, sorted(set(t))) for (key, _, _), t in zip(heavy, shards)], [round(x) for x, _ in sorted(heap, key=lambda h: h[1])])


#: Groups of keys with a sketch each: sketches merge in so many places, and a task can hold so many at once.
SKETCHES = 128


def plan_loads(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> LoadPlan:
    """The plan for df's rows by keys, in one pass over them; keys that are null in any column are left out."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
    groups, tracked = min(tasks, SKETCHES), 512
    while tracked * groups < 256 * tasks:
        tracked *= 2
    top = F.call_function("approx_top_k", F.col("h"), F.lit(min(4 * tasks, tracked)), F.lit(tracked))
    sketched = df.filter(some).select(_hash(keys).alias("h")).groupBy(F.pmod("h", F.lit(groups)).alias("g")).agg(F.count(F.lit(1)).alias("n"), top.alias("top"))
    found = sketched.select("n", F.filter("top", lambda x: x["count"] * (4 * tasks) >= F.col("n")).alias("top")).collect()
    rows = sum(r.n for r in found)
    least = max(2, rows / (4 * tasks))
    heavy = [(x["item"], x["count"]) for r in found for x in r.top if x["count"] >= least]
    count = tasks * BINS_PER_TASK
    each = max(0, rows - sum(n for _, n in heavy)) // count
    loads, placed = [each] * count, []
    for key, load in sorted(heavy, key=lambda h: (-h[1], h[0])):
        loads[key % count] += load
        placed.append((key, key % count, load))
    return pack(loads, placed, tasks)


def _with_shards(df: DataFrame, keys: Sequence[str], plan: LoadPlan) -> tuple[DataFrame, str, str]:
    """df with the hash of the row's key and, if the key is split, the tasks of its shards, a table bounded by the tasks."""
    key, shards = (columns_named(df, c) for c in ("hash", "shards"))
    heavy = df.sparkSession.createDataFrame(plan.heavy, f"{key} long, {shards} array<int>")
    return df.withColumn(key, _hash(keys)).join(F.broadcast(heavy), key, "left"), key, shards


def _routes(df: DataFrame, keys: Sequence[str], plan: LoadPlan) -> tuple[DataFrame, str, str]:
    """df with the tasks of the row's bin and, if its key is split, of its shards; both tables are bounded by the tasks."""
    out, key, shards = _with_shards(df, keys, plan)
    home, at = columns_named(df, "home"), columns_named(df, "bin")
    bins = df.sparkSession.createDataFrame([(n, t) for n, t in enumerate(plan.bins)], f"{at} int, {home} int")
    out = out.withColumn(at, F.pmod(F.col(key), F.lit(len(plan.bins))).cast("int")).join(F.broadcast(bins), at)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], home, shards), home, shards


def _spread(df: DataFrame, shard_by: Sequence[str] | None) -> Column:
    """A number that depends on the row alone, so that a task that is run again makes the same choice."""
    kinds = df.schema
    return F.xxhash64(F.lit(7), *[F.to_json(F.col(f"`{c}`")) if isinstance(kinds[c].dataType, T.MapType) else F.col(f"`{c}`") for c in (shard_by or df.columns)])


def fragmented(df: DataFrame, keys: Sequence[str], plan: LoadPlan, shard_by: Sequence[str] | None = None, task: str = "task") -> DataFrame:
    """df with the task each row belongs to, by default choosing among a key's shards by all of its columns.

    Rows that are null in a key match nothing and spread over all tasks.
    """
    routed, home, shards = _routes(df, keys, plan)
    spread = _spread(df, shard_by)
    null = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    chosen = (
        F.when(null, F.pmod(spread, F.lit(plan.tasks)).cast("int"))
        .when(F.col(shards).isNotNull(), F.get(F.col(shards), F.pmod(spread, F.size(shards)).cast("int")))
        .otherwise(F.col(home))
    )
    return routed.withColumn(task, chosen).drop(home, shards)


def replicated(df: DataFrame, keys: Sequence[str], plan: LoadPlan, task: str = "task") -> DataFrame:
    """df with one row for each task that holds rows of its key; rows null in a key are dropped."""
    routed, home, shards = _routes(df.dropna(subset=list(keys)), keys, plan)
    return routed.withColumn(task, F.explode(F.coalesce(F.col(shards), F.array(home)))).drop(home, shards)


def fragment_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", plan: LoadPlan | None = None, tasks: int | None = None, shard_by: Sequence[str] | None = None) -> DataFrame:
    """left joined with right on keys, with left's large keys split over tasks and right's rows copied to them.

    how is inner, left, left_semi or left_anti. Null keys match nothing, as in SQL; repeated rows on
    either side multiply as in SQL. Columns of both sides other than keys must differ in name, as in
    any join by names. Empty sides give what SQL gives.
    """
    plan = plan or plan_loads(left, keys, tasks)
    task = columns_named(left.select("*"), "task")
    while task in right.columns:
        task = f"_{task}"
    a = fragmented(left, keys, plan, shard_by, task).repartitionById(plan.tasks, F.col(task))
    b = replicated(right, keys, plan, task).repartitionById(plan.tasks, F.col(task))
    return a.join(b, [task, *keys], how).drop(task)


#: So many keys are sent to all tasks at most.
FEW_KEYS = 50_000


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", few: int = FEW_KEYS, shard_by: Sequence[str] | None = None) -> DataFrame:
    """left joined with right, a table that was written already, on keys; how as in fragment_join.

    right is counted: up to `few` rows go to the tasks, so that left stays where it is; beyond that
    left's large keys are split over tasks. The rows are the same either way.
    """
    if right.count() <= few:
        return left.join(F.broadcast(right), list(keys), how)
    return fragment_join(left, right, keys, how, shard_by=shard_by)


def semi_join(left: DataFrame, right: DataFrame, keys: Sequence[str], few: int = FEW_KEYS) -> DataFrame:
    """Rows of left whose keys are in right, a table that was written already."""
    return key_join(left, right.select(*keys), keys, "left_semi", few)


def fragment_counts(df: DataFrame, keys: Sequence[str], within: Sequence[str] = (), count: str = "n", tasks: int | None = None, shard_by: Sequence[str] | None = None) -> DataFrame:
    """Rows of df by keys and within: counted in each shard of a key, and the shards' counts then added.

    Rows are summed map-side, so a task sends each distinct value of a shard once; the sums of a large
    key, one from every task of a large input, meet in as many places as the key has shards. Rows that
    are null in a key are left out; nulls of within are values.
    """
    plan = plan_loads(df, keys, tasks)
    columns = [*keys, *within]
    marked, _, shards = _with_shards(df.dropna(subset=list(keys)), keys, plan)
    shard = columns_named(df, "shard")
    while shard == count:
        shard = f"_{shard}"
    placed = marked.withColumn(shard, F.coalesce(F.get(F.col(shards), F.pmod(_spread(df, shard_by), F.size(shards)).cast("int")), F.lit(-1)))
    by_shard = placed.groupBy(shard, *columns).agg(F.count(F.lit(1)).alias(count))
    return by_shard.groupBy(*columns).agg(F.sum(count).alias(count))
