import random

from pyspark.sql import functions as F

from shelfmark.operators.ranking import with_group_rank
from shelfmark.operators.skew import fragment_counts, fragment_join, key_join, pack, plan_loads


def skewed(spark, n=20_000):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 101 == 0, F.lit(None)).otherwise((F.col("id") % 500).cast("string"))
    return spark.range(n).select("id", key.alias("k"), F.lit(1).alias("task"), F.col("id").alias("home"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_joins_give_what_plain_joins_give(spark):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), ("nobody", 4), (None, 5)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(fragment_join(left, right, ["k"], how).select("id", "k")) == rows(left.join(right, "k", how).select("id", "k")), how
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert rows(fragment_join(a, b, ["k"], "left").select("id")) == rows(a.select("id"))


def test_a_hot_key_is_split_and_the_plan_is_bounded(spark):
    plan = plan_loads(skewed(spark), ["k"], tasks=8)
    hot = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert [k for k, _ in plan.heavy] == [hot] and len(plan.heavy[0][1]) >= 3
    assert max(plan.loads) < 1.3 * sum(plan.loads) / 8
    assert len(plan.bins) == 8 * 32


def test_packing_balances():
    rng = random.Random(1)
    loads = [rng.randrange(100) for _ in range(320)]
    loads[5] += 20_000
    plan = pack(loads, [(("h",), 5, 20_000)], 10)
    assert sum(plan.loads) in range(sum(loads) - 10, sum(loads) + 10)
    assert max(plan.loads) < 1.25 * sum(loads) / 10


def test_rows_reach_every_task(spark):
    left = skewed(spark)
    out = fragment_join(left, spark.createDataFrame([("hot", 1)], "k string, v int"), ["k"], tasks=8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)


def test_a_counted_table_joins_alike_either_way(spark):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), (None, 5)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(key_join(left, right, ["k"], how, few=0).select("id", "k")) == rows(key_join(left, right, ["k"], how).select("id", "k")), how


def test_counts(spark):
    df = skewed(spark)
    got = {(r.k, r.task): r.n for r in fragment_counts(df, ["k"], ["task"]).collect()}
    want = {(r.k, 1): r["count"] for r in df.dropna(subset=["k"]).groupBy("k").count().collect()}
    assert got == want
    assert fragment_counts(df.limit(0), ["k"]).count() == 0


def test_counts_of_binary_and_null_values(spark):
    df = spark.createDataFrame([(b"a", None), (b"a", None), (b"a", 1), (None, 1)], "k binary, v int")
    assert {(bytes(r.k), r.v, r.n) for r in fragment_counts(df, ["k"], ["v"]).collect()} == {(b"a", None, 2), (b"a", 1, 1)}


def test_ranks(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("g"), (-F.col("id")).alias("o"), F.lit("x").alias("piece"), F.lit(0).alias("rank"))
    got = with_group_rank(df, ["g"], ["o"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.o, r["rank"]))
    for ranks in by.values():
        assert [n for _, n in sorted(ranks)] == list(range(len(ranks)))
    assert len(got) == 3000 and with_group_rank(df.limit(0), ["g"], ["o"]).count() == 0


def test_ranks_of_equal_rows_are_all_different(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), F.lit(1).alias("o"))
    assert sorted(r["rank"] for r in with_group_rank(df, ["g"], ["o"]).collect()) == list(range(500))


def test_more_tasks_than_sketches(spark):
    plan = plan_loads(skewed(spark), ["k"], tasks=300)
    hot = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert plan.heavy[0][0] == hot or hot in dict(plan.heavy)
    assert len(dict(plan.heavy)[hot]) > 50 and max(plan.loads) < 3 * sum(plan.loads) / 300
