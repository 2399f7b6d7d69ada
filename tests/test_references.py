from datetime import datetime

from pyspark.sql import functions as F

from shelfmark.operators.references import Reference, orphan_report, orphans


def reference(spark, children, parents, scoped=False):
    c = spark.createDataFrame(children, "id string, ref string, at timestamp, scope string, key string, month int")
    p = spark.createDataFrame(parents, "ref string, born timestamp, gone timestamp, scope string, key string")
    return Reference("c", c, c.id, c.ref, c.at, "p", p, p.ref, p.born, p.gone, c.scope if scoped else None, p.scope if scoped else None)


def day(month, d=1, *time):
    return datetime(2025, month, d, *time)


def found(*args, **kw):
    return {tuple(r) for r in orphans([reference(*args, **kw)]).collect()}


def child(n, ref, at, scope="s"):
    return (n, ref, at, scope, "clash", 1)


def parent(ref, born, gone=None, scope="s"):
    return (ref, born, gone, scope, "clash")


def test_missing_late_deleted_and_reborn(spark):
    parents = [parent("late", day(3, 1)), parent("gone", day(1, 1), day(2, 1)), parent("twice", day(1, 1), day(1, 20)), parent("twice", day(3, 5)), parent("ok", day(1, 31, 23, 59)), parent("ok", day(1, 31, 23, 59)), parent("never", None)]
    children = [child("1", "absent", day(1)), child("2", "late", day(2, 28)), child("3", "late", day(3)), child("4", "gone", day(1)), child("5", "gone", day(2)), child("6", "twice", day(1)), child("7", "twice", day(2)), child("8", "twice", day(3, 1)), child("9", "ok", day(1)), child("10", "never", day(1)), child("11", None, day(1)), child("12", "absent", None), child("1", "absent", day(1))]
    assert found(spark, children, parents) == {("c", "1", "2025-01"), ("c", "2", "2025-02"), ("c", "5", "2025-02"), ("c", "6", "2025-01"), ("c", "7", "2025-02"), ("c", "10", "2025-01")}


def test_deleted_exactly_at_the_end_of_the_month_still_lived(spark):
    parents = [parent("a", day(1), day(2, 1)), parent("b", day(1), day(1, 31, 23, 59, 59))]
    assert found(spark, [child("1", "a", day(1, 5)), child("2", "b", day(1, 5))], parents) == {("c", "2", "2025-01")}


def test_scopes(spark):
    children = [child("1", "x", day(1), "s"), child("2", "x", day(1), "t"), child("3", "x", day(1), None)]
    assert found(spark, children, [parent("x", day(1))], scoped=True) == {("c", "2", "2025-01"), ("c", "3", "2025-01")}


def test_empty_tables(spark):
    assert found(spark, [], [parent("x", day(1))]) == set()
    assert found(spark, [child("1", "x", day(1))], []) == {("c", "1", "2025-01")}


def test_report_and_a_hot_key(spark):
    c = spark.range(9000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("fine").alias("ref"), F.lit(day(1)).alias("at"))
    p = spark.createDataFrame([("fine", day(1))], "ref string, born timestamp")
    r = Reference("c", c, c.id, c.ref, c.at, "p", p, p.ref, p.born, F.lit(None).cast("timestamp"))
    assert [tuple(x) for x in orphan_report([r]).collect()] == [("c", "p", "2025-01", 1, 3000)]
    assert orphans([r]).count() == orphans([r], few=0).count() == 3000
