"""Filling containers of fixed capacity with items of varying length."""

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import Optional

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from shelfmark.operators.ranking import last_at_most, with_group_rank
from shelfmark.operators.skew import key_join
from shelfmark.session import materialise


def default_tokenizer() -> str:
    """Path of a public byte-level vocabulary, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: Optional[str] = None) -> Column:
    """Tokens of a text under the vocabulary at path; none for null."""
    path = path or default_tokenizer()

    @pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for batch in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return count(text)


def plan_containers(histogram: Mapping[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best fit, longest first, over counts of lengths: the runs of slots of each length, and the number of containers.

    A run (first, end, container, each) says that items with ranks from first to before end of that
    length go into consecutive containers from that one on, so many into each. Containers alike are one
    range, so time and memory follow the distinct lengths, of which there are at most capacity, and not
    the items.
    """
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: ranges (first container, how many)
    rooms: list[int] = []
    made = 0

    def keep(left: int, first: int, many: int) -> None:
        if many and left:
            if not room[left]:
                insort(rooms, left)
            room[left].append((first, many))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"an item of {length} is longer than {capacity}")
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, many = room[left].pop()
                if not room[left]:
                    rooms.pop(at)
            else:
                left, first = capacity, made
                many = -(-todo // (capacity // length))
                made += many
            each = left // length
            filled = min(many, todo // each)
            if filled:
                runs[length].append((rank, rank + filled * each, first, each))
                keep(left - each * length, first, filled)
                rank, todo, first, many = rank + filled * each, todo - filled * each, first + filled, many - filled
            if todo and many:  # fewer than fit into one container
                runs[length].append((rank, rank + todo, first, each))
                keep(left - todo * length, first, 1)
                rank, todo, first, many = rank + todo, 0, first + 1, many - 1
            keep(left, first, many)
    if histogram.get(0):
        runs[0].append((0, histogram[0], 0, histogram[0]))
        made = max(made, 1)
    return dict(runs), made


#: The most capacities that are planned for at once.
MOST_CAPACITIES = 1000


def pieces(items: DataFrame, capacities: DataFrame, length: str, capacity: str) -> DataFrame:
    """Each item once for each capacity, or, where it is longer, once for each piece of it: with piece and piece_length.

    All pieces but the last have the full capacity. Capacities are a list of settings; more than
    MOST_CAPACITIES are refused.
    """
    settings = capacities.filter(F.col(capacity) > 0)
    given = settings.limit(MOST_CAPACITIES + 1).collect()
    if len(given) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    each = F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in settings.schema]) for r in given])
    both = items.withColumn("_c", F.explode(each) if given else F.explode(F.array().cast(T.ArrayType(settings.schema)))).select("*", "_c.*").drop("_c")
    n, c = F.coalesce(F.col(length), F.lit(0)).cast("long"), F.col(capacity).cast("long")
    last = F.greatest(F.ceil(n / c) - 1, F.lit(0)).cast("int")
    return both.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("piece_length", F.least(c, n - F.col("piece") * c))


def containers(items: DataFrame, item: str, length: str, capacities: DataFrame, capacity_id: str, capacity: str) -> DataFrame:
    """(capacity_id, item, piece, piece_length, container): where each item goes, for each capacity on its own.

    The driver gets counts by length, at most as many as the capacity, and plans on them. Items then get
    their rank within their length, and with it their slot: they meet the runs of their length, which are
    counted and go to all tasks if they are few, and find theirs by halving, so that the time of an item
    grows with the logarithm of the runs only.

    An item stays whole unless it is longer than the capacity; then all its pieces but the last fill a
    container each, and the last is packed as an item. An item without length, or with length null or 0,
    takes no room and is in container 0. Repeated items are items each. Capacities that are null or not
    positive hold nothing and give no rows; empty tables give none either.
    """
    sized = items.select(F.col(item).alias("item"), F.col(length).alias("n"))
    caps = capacities.select(F.col(capacity_id).alias("capacity_id"), F.col(capacity).alias("capacity")).dropDuplicates(["capacity_id"])
    cut = pieces(sized, caps, "n", "capacity").select("capacity_id", "capacity", "item", "piece", "piece_length")
    counts: dict[tuple, dict[int, int]] = defaultdict(dict)
    for r in cut.groupBy("capacity_id", "capacity", "piece_length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.capacity_id, r.capacity][r.piece_length] = r.n
    plan = [
        (cid, size, [run[0] for run in runs], [run[2] for run in runs], [run[3] for run in runs])
        for (cid, capacity_), histogram in counts.items()
        for size, runs in plan_containers(histogram, capacity_)[0].items()
    ]
    spark = items.sparkSession
    kind = cut.schema["capacity_id"].dataType.simpleString()
    slots = spark.createDataFrame(plan, f"capacity_id {kind}, piece_length long, firsts array<long>, boxes array<long>, each array<long>")
    ranked = with_group_rank(cut, ["capacity_id", "piece_length"], ["item", "piece"])
    placed = key_join(ranked, materialise(slots), ["capacity_id", "piece_length"], shard_by=["item", "piece"])
    longest = max((len(firsts) for _, _, firsts, _, _ in plan), default=1)
    placed = placed.withColumn("run", last_at_most(F.col("firsts"), F.col("rank"), longest))
    first, box, each = (F.get(F.col(c), F.col("run")) for c in ("firsts", "boxes", "each"))
    return placed.select(
        F.col("capacity_id").alias(capacity_id), F.col("item").alias(item), "piece", "piece_length",
        (box + F.floor((F.col("rank") - first) / each)).cast("long").alias("container"),
    )


def measured(documents: DataFrame, item: str, text: str, path: Optional[str] = None) -> DataFrame:
    """(item, tokens), counted once and written, since planning and placing both read it."""
    return materialise(documents.select(F.col(item), token_count(F.col(text), path).alias("tokens")))
