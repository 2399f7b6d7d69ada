import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.values import known_map, known_text
from shelfmark.llm.survivors import survivors

SCHEMA = "h string, id string, key string, at long, size long, etag string, kind string, meta map<string,string>, named boolean, g int, m string, winner string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, *[None] * (12 - len(r))) for r in rows], SCHEMA)
    known = {"size": F.col("size"), "at": F.col("at"), "etag": known_text(F.col("etag")), "kind": known_text(F.col("kind")), "meta": known_map(F.col("meta"))}
    out = survivors(df, "h", "id", ["size", "at", "etag", "kind", "meta"], "at", "key", ["kind", "etag", "meta"], F.coalesce("named", F.lit(False)), known, **{"most": 20, **kw})
    return {(r.winner, r.field_name): r.donor for r in out.collect()}


def test_rules(spark):
    rows = [
        ("h", "1", "b", 5, 1, "e", "unknown", None), ("h", "2", "a", 5, 1, "e", "", {}), ("h", "3", "c", 9, 1, '""', "text/plain", None), ("h", "4", "d", None, None, None, "text/html", {"a": "b"}),
        ("alone", "5", "a", 1, 1, "e", "x", {"a": "b"}),
    ]
    # all of 1, 2 and 3 know three values, and 3 is the latest
    assert run(spark, rows) == {("3", "kind"): "3", ("3", "etag"): "2", ("3", "meta"): "4"}
    rows[3] = (*rows[3], True)
    assert run(spark, rows) == {("4", "kind"): "4", ("4", "etag"): "2", ("4", "meta"): "4"}


def test_sizes_nulls_and_repeats(spark):
    many = [("big", str(n), str(n), n, 1, "e", "k", None) for n in range(21)]
    rows = [*many, (None, "x", "x", 1), (None, "y", "y", 1), ("n", None, "a", 1), ("n", "z", "b", 1), ("two", "p", "p", 1, 1, "e"), ("two", "p", "p", 1, 1, "e"), ("two", "q", "q", 1, 1, None)]
    assert run(spark, rows) == {("p", "etag"): "p"}
    assert run(spark, many[:20]) == {("19", "kind"): "19", ("19", "etag"): "19"}
    assert run(spark, []) == {}


def test_crowded_and_repeated_groups(spark):
    df = [("hot", str(n), str(n), n, 1, "e", "k", None) for n in range(3000)] + [("again", str(n % 2 + 9000), "k", n % 2, 1, "e", None, None) for n in range(3000)] + [("ok", "a", "a", 1, 1, "e", None, None), ("ok", "b", "b", 2, 1, None, None, None)]
    assert run(spark, df) == {("9001", "etag"): "9001", ("a", "etag"): "a"}


def test_groups_of_any_size(spark):
    df = [("hot", str(n), str(n), n % 900, 1, "e" if n == 7 else None, "k", None) for n in range(3000)]
    assert run(spark, df, most=None) == {("7", "kind"): "7", ("7", "etag"): "7"}
    assert run(spark, df) == {}


def test_a_repeated_member_counts_by_its_first_row(spark):
    rows = [("h", "1", "z", 5, 1, "e"), ("h", "1", "a", 5, None, None), ("h", "2", "m", 5, 1, "e")]
    assert run(spark, rows) == {("2", "etag"): "2"}
    assert run(spark, [rows[0], ("h", "1", "b", 5, 1, "e"), rows[2]]) == {("1", "etag"): "1"}


@pytest.mark.parametrize("most, many", [(20, 60), (None, 60), (None, 2)])
def test_against_a_model(spark, most, many):
    rng = random.Random(6)
    rows = [(f"h{rng.randrange(many)}", f"id{n}", f"k{rng.randrange(400)}", rng.choice([None, rng.randrange(9)]), rng.choice([None, 1]), rng.choice([None, "", "e"]), rng.choice([None, "unknown", "k"]), rng.choice([None, {}, {"a": "b"}]), rng.random() < 0.1) for n in range(400)]
    want = {}
    for h in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == h]
        if not 2 <= len(group) <= (most or len(group)):
            continue
        has = lambda r: {"size": r[4] is not None, "at": r[3] is not None, "etag": bool(r[5]), "kind": r[6] == "k", "meta": bool(r[7])}
        recent = lambda r: (r[3] is None, -(r[3] or 0), r[2], r[1])
        winner = min(group, key=lambda r: (not r[8], -sum(has(r).values()), *recent(r)))
        for field in ("kind", "etag", "meta"):
            donors = [winner] if has(winner)[field] else sorted((r for r in group if has(r)[field]), key=recent)
            if donors:
                want[winner[1], field] = donors[0][1]
    assert run(spark, rows, most=most) == want
