import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm.packing import containers, plan_containers, token_count
from shelfmark.operators.ranking import last_at_most
from shelfmark.operators.skew import key_join


def unroll(runs):
    held = Counter()
    for length, parts in runs.items():
        covered = []
        for first, end, container, each in parts:
            covered += range(first, end)
            for rank in range(first, end):
                held[container + (rank - first) // each] += length
        assert covered == list(range(len(covered)))
        yield length, len(covered)
    yield None, held


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.integers(1, 400), max_size=20))
def test_plans_hold_everything_and_overfill_nothing(histogram):
    runs, made = plan_containers(histogram, 50)
    placed = dict(unroll(runs))
    held = placed.pop(None)
    assert placed == histogram
    assert all(v <= 50 for v in held.values()) and (not held or max(held) < made)


def best_fit(items, capacity):
    """Best fit, longest first, item by item."""
    left = []
    for x in sorted(items, reverse=True):
        fits = [n for n, r in enumerate(left) if r >= x]
        if fits:
            left[min(fits, key=lambda n: left[n])] -= x
        else:
            left.append(capacity - x)
    return len(left)


def test_as_many_containers_as_best_fit_over_items():
    rng = random.Random(3)
    for _ in range(20):
        items = [rng.choice([rng.randint(1, 100), 33, 51]) for _ in range(300)]
        assert plan_containers(Counter(items), 100)[1] == best_fit(items, 100)


def test_planning_follows_lengths_and_not_items():
    runs, made = plan_containers({n: 10**12 + n for n in range(1, 513)}, 512)
    assert made > 10**12 and sum(map(len, runs.values())) < 20_000


def test_too_long_items_are_refused_by_the_plan():
    with pytest.raises(ValueError):
        plan_containers({9: 1}, 8)


def test_containers(spark):
    rng = random.Random(5)
    rows = [(n, rng.choice([rng.randint(1, 40), 7, 7, 95, 250]), "clash", 3) for n in range(800)] + [(900, 0, "x", 1), (901, None, "x", 1)]
    items = spark.createDataFrame(rows, "doc long, n int, piece string, container int")
    caps = spark.createDataFrame([(1, 100), (2, 64), (3, 0), (4, None), (1, 100)], "cid int, cap int")
    out = containers(items, "doc", "n", caps, "cid", "cap").toPandas()
    for cid, cap in ((1, 100), (2, 64)):
        own = out[out.cid == cid]
        assert set(own.doc) == {r[0] for r in rows}
        whole = own.groupby("doc").piece_length.sum()
        assert all(whole[r[0]] == (r[1] or 0) for r in rows)
        short = own[own.doc.isin([r[0] for r in rows if (r[1] or 0) <= cap])]
        assert not short.doc.duplicated().any()
        assert own.groupby("container").piece_length.sum().max() <= cap
        assert own.container.nunique() <= 1.02 * own.piece_length.sum() / cap + 2
    assert set(out.cid) == {1, 2}
    assert containers(items.limit(0), "doc", "n", caps, "cid", "cap").count() == 0 and containers(items, "doc", "n", caps.limit(0), "cid", "cap").count() == 0


def test_one_length_for_all(spark):
    items = spark.range(5000).select(F.col("id").alias("doc"), F.lit(30).alias("n"))
    caps = spark.createDataFrame([(1, 100)], "cid int, cap int")
    out = containers(items, "doc", "n", caps, "cid", "cap").groupBy("container").count().groupBy("count").count().collect()
    assert sorted(tuple(r) for r in out) == [(2, 1), (3, 1666)]


def test_tokens(spark):
    rows = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("x" * 20_000,)], "t string").select(token_count(F.col("t")).alias("n")).collect()
    counts = [r.n for r in rows]
    assert counts[:3] == [2, 0, 0] and counts[3] > 1 and 0 < counts[4] < 20_000


def test_the_run_of_a_rank_is_found_by_halving(spark):
    for values in ([0], [0, 5], [0, 1, 7, 8, 30], list(range(0, 300, 3))):
        df = spark.range(0, values[-1] + 3).select(F.col("id"), F.array(*map(F.lit, values)).alias("v"))
        got = {r.id: r.at for r in df.select("id", last_at_most(F.col("v"), F.col("id"), len(values)).alias("at")).collect()}
        assert got == {x: max(n for n, v in enumerate(values) if v <= x) for x in got}


def test_runs_that_are_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr("shelfmark.llm.packing.key_join", lambda *a, **k: key_join(*a, **{**k, "few": 0}))
    rng = random.Random(9)
    items = spark.createDataFrame([(n, rng.choice([7, rng.randint(1, 100)])) for n in range(800)], "i long, n long")
    caps = spark.createDataFrame([(1, 100), (2, 64)], "c int, s int")
    held = Counter()
    for r in containers(items, "i", "n", caps, "c", "s").collect():
        held[r.c, r.container] += r.piece_length
    assert max(v for (c, _), v in held.items() if c == 1) <= 100 and max(v for (c, _), v in held.items() if c == 2) <= 64
    assert sum(v for (c, _), v in held.items() if c == 1) == items.agg(F.sum("n")).first()[0]
