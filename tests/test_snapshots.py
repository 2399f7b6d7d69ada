import random

from pyspark.sql import functions as F

from shelfmark.operators.snapshots import KeptSnapshots, bounds_of, snapshot_changes

SCHEMA = "b string, n int, key string, size long, inode long, dev long, at int, s string, k string, kind string"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, *[None] * (10 - len(r))) for r in rows], SCHEMA)
    out = snapshot_changes(df, "b", "n", "key", ["size", "inode", "dev"], ["inode", "dev", "size"], "at")
    return sorted(tuple(r) for r in out.collect())


def test_kinds(spark):
    rows = [
        ("b", 1, "same", 1, 1, 1), ("b", 1, "edit", 1, 2, 1), ("b", 1, "gone", 1, 3, 1), ("b", 1, "from", 9, 4, 1), ("b", 1, "nulls", None, None, None),
        ("b", 3, "same", 1, 1, 1), ("b", 3, "edit", 2, 2, 1), ("b", 3, "come", 1, 5, 1), ("b", 3, "to", 9, 4, 1), ("b", 3, "nulls", None, None, None),
        ("other", 2, "x", 1, 1, 1),
    ]
    assert changes(spark, rows) == [("b", 3, "added", "", "come"), ("b", 3, "changed", "edit", "edit"), ("b", 3, "moved", "from", "to"), ("b", 3, "removed", "gone", "")]


def test_moves_pair_in_order_and_unknown_identities_do_not_move(spark):
    rows = [("b", 1, k, 1, 7, 1) for k in "cab"] + [("b", 1, "n", None, 7, 1)] + [("b", 2, k, 1, 7, 1) for k in "zy"] + [("b", 2, "m", None, 7, 1)]
    assert changes(spark, rows) == [("b", 2, "added", "", "m"), ("b", 2, "moved", "a", "y"), ("b", 2, "moved", "b", "z"), ("b", 2, "removed", "c", ""), ("b", 2, "removed", "n", "")]


def test_repeats_take_the_row_loaded_last(spark):
    rows = [("b", 1, "a", 1, 1, 1, 1), ("b", 2, "a", 5, 1, 1, 1), ("b", 2, "a", 1, 1, 1, 2), ("b", 2, "a", 1, 1, 1, 2)]
    assert changes(spark, rows) == []


def test_nulls_and_empty(spark):
    assert changes(spark, [(None, 1, "a"), ("b", None, "a"), ("b", 1, None)]) == []
    assert changes(spark, []) == []


def test_a_key_that_comes_back(spark):
    rows = [("b", 1, "a", 1, None, 1), ("b", 2, "x", 1, None, 1), ("b", 3, "a", 1, None, 1)]
    assert changes(spark, rows) == [("b", 2, "added", "", "x"), ("b", 2, "removed", "a", ""), ("b", 3, "added", "", "a"), ("b", 3, "removed", "x", "")]


def model(rows):
    out = []
    numbers = sorted({r[1] for r in rows})
    for a, b in zip(numbers, numbers[1:]):
        old, new = {r[2]: r[3:6] for r in rows if r[1] == a}, {r[2]: r[3:6] for r in rows if r[1] == b}
        out += [("b", b, "changed", k, k) for k in old.keys() & new.keys() if old[k] != new[k]]
        gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
        for k in list(gone):
            match = next((c for c in come if new[c] == old[k] and None not in old[k]), None)
            if match:
                out.append(("b", b, "moved", k, match))
                come.remove(match)
            else:
                out.append(("b", b, "removed", k, ""))
        out += [("b", b, "added", "", k) for k in come]
    return sorted(out)


def test_random_listings_against_a_model(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [("b", n, f"k{k}", rng.choice([1, 2, None]), rng.choice([1, 2, 3, None]), 1) for n in (1, 2, 4, 5) for k in range(25) if rng.random() < 0.6]
        assert changes(spark, rows) == model(rows)


def test_one_identity_for_most_files(spark):
    df = spark.range(4000).select(F.lit("b").alias("b"), (F.col("id") % 2 + 1).cast("int").alias("n"), F.format_string("k%05d", "id").alias("key"), F.lit(1).alias("size"), F.lit(0).alias("inode"), F.lit(0).alias("dev"))
    out = snapshot_changes(df, "b", "n", "key", ["size"], ["inode", "dev", "size"])
    assert [tuple(r) for r in out.groupBy("change_kind").count().collect()] == [("moved", 2000)]


def test_a_new_listing_is_compared_with_the_last_one_only(spark, tmp_path):
    rng = random.Random(7)
    rows = [("b", n, f"k{k:03d}", rng.choice([1, 2]), rng.choice([1, 2, 3, None]), 1) for n in (1, 2, 3, 5) for k in range(200) if rng.random() < 0.7]
    load = lambda some: spark.createDataFrame([(*r, *[None] * (10 - len(r))) for r in some], SCHEMA)
    kept = KeptSnapshots(spark, str(tmp_path / "kept"), ["size", "inode", "dev"], ["inode", "dev", "size"], ranges=4)
    for n in (1, 2, 3):
        kept.add(load([r for r in rows if r[1] == n]), "b", "n", "key", "at")
    assert sorted(tuple(r) for r in kept.changes().collect()) == model([r for r in rows if r[1] < 5])
    kept.add(load([r for r in rows if r[1] == 5][:50]), "b", "n", "key", "at")
    kept.add(load([r for r in rows if r[1] == 5][50:]), "b", "n", "key", "at")  # rows that come late
    assert sorted(tuple(r) for r in kept.changes([5]).collect()) == [c for c in model(rows) if c[1] == 5]
    assert sorted(tuple(r) for r in kept.changes().collect()) == model(rows)
    plan = kept.merged(kept.steps().filter("after = 5"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("shufflepartitionidpassthrough") == 2 and "hashpartitioning" not in plan
    assert "n#" in plan and "IN (3,5)" in plan  # a filter of partitions


def test_ranges_share_the_keys(spark):
    df = spark.range(20_000).select(F.format_string("b%d", F.col("id") % 3).alias("s"), F.format_string("k%06d", "id").alias("k"))
    bounds = bounds_of(df, 8)
    assert len(bounds) == 7 and bounds == sorted(bounds) and bounds_of(df.limit(0), 8) == []
