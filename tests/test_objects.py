import hashlib
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.scalars import key_name, key_prefix
from shelfmark.operators import objects as O
from shelfmark.sources.config import load
from shelfmark.streaming.background import Background


def test_put_checks_claims_and_keeps_ids(spark):
    tag = lambda b: f'"{hashlib.md5(b).hexdigest()}"'
    uploads = spark.createDataFrame([("b", "a/x", b"hello", tag(b"hello"), None), ("b", "y", b"hi", tag(b"no"), None), ("b", "z", b"", None, "wrong")], "bucket string, key string, content binary, claimed_etag string, claimed_checksum_sha1 string")
    got = O.received(uploads)
    assert {r.key: r.refused for r in got.collect()} == {"a/x": None, "y": "etag", "z": "checksum_sha1"}
    old = spark.createDataFrame([("b", "a/x", "kept", 1, 1, "old")], "bucket string, key string, id string, created_at_ns long, scan_level int, etag string")
    assert [tuple(r) for r in O.stored(old, got, 9).collect()] == [("b", "a/x", "kept", 1, 3, tag(b"hello"))]


def test_parts_and_completion(spark):
    parts = spark.createDataFrame([("u", 1, "p"), ("u", 0, "p"), ("u", 10_001, "p"), (None, 1, "p"), ("u", None, "p")], "upload_id string, part_number int, etag string")
    assert [r.refused for r in O.accepted(parts).collect()] == [None, "invalid_part_number", "invalid_part_number", "no_such_upload", "invalid_part_number"]
    md5 = lambda b: f'"{hashlib.md5(b).hexdigest()}"'
    uploads = spark.createDataFrame([("b", "u", "d/k", None), ("b", "v", "k2", "text/plain")], "bucket string, id string, key string, content_type string")
    held = spark.createDataFrame([("u", 1, md5(b"1"), 5), ("u", 2, md5(b"2"), 6), ("v", 1, md5(b"1"), 5)], "upload_id string, part_number int, etag string, size long")
    asked = spark.createDataFrame([("u", 1, 2, md5(b"2")), ("u", 2, 1, md5(b"1")), ("v", 1, 1, "other"), ("w", 1, 1, "x")], "upload_id string, position int, part_number int, etag string")
    made, outcomes = O.completed(uploads, held, asked, 7)
    assert {r.upload_id: r.outcome for r in outcomes.collect()} == {"u": "complete", "v": "invalid_part", "w": "no_such_upload"}
    row = made.collect()[0]
    whole = hashlib.md5(hashlib.md5(b"2").digest() + hashlib.md5(b"1").digest()).hexdigest()
    assert (row.key, row.prefix, row.size, row.etag, row.content_type, row.scan_level) == ("d/k", "d/", 11, f'"{whole}-2"', "application/octet-stream", 2)


def test_recursive_sizes(spark):
    df = spark.createDataFrame([("b", "r", 1), ("b", "a/x", 2), ("b", "a/b/y", None), ("b", "a/b/z", 4)], "bucket string, key string, size long").withColumns({"prefix": key_prefix(F.col("key")), "name": key_name(F.col("key"))})
    assert {r.directory: (r.files, r.bytes) for r in O.recursive_sizes(df).collect()} == {"": (4, 7), "a/": (3, 6), "a/b/": (2, 4)}


def test_stored_hashes(spark):
    schema = "bucket string, prefix string, dir_hash string, file_count int, total_size long, stale boolean"
    old = spark.createDataFrame([("b", "a/", None, 0, 0, True), ("b", "c/", "h", 1, 1, True), ("b", "", None, 0, 0, True)], schema)
    new = spark.createDataFrame([("b", "a/", "n", 2, 3), ("b", "none/", "x", 1, 1)], "bucket string, prefix string, dir_hash string, file_count int, total_size long")
    assert {r.prefix for r in O.unhashed_directories(old).collect()} == {"a/", "c/"}
    assert {r.prefix: (r.dir_hash, r.stale) for r in O.with_stored_hashes(old, new).collect()} == {"a/": ("n", False), "c/": ("h", True), "": (None, True)}


def test_requests(spark):
    ask = lambda text: spark.createDataFrame([(text,)], "q string").select(O.canonical_query(F.col("q"))).collect()[0][0]
    assert ask("b=2&a=x+y&a=%2F&&c") == "a=%2F&a=x%20y&b=2&c=" and ask("") == "" and ask("k=a=b") == "k=a%3Db"
    late = lambda text, n: spark.createDataFrame([(text,)], "q string").select(O.expired(F.col("q"), F.lit(n), F.lit("2025-01-01 00:01:00").cast("timestamp"))).collect()[0][0]
    assert [late("20250101T000000Z", 60), late("20250101T000000Z", 59), late("20250101T000200Z", 60), late("never", 60)] == [False, True, True, True]


def test_xml_and_config(spark, tmp_path):
    df = spark.createDataFrame([("a&b", 1)], "Key string, Size long")
    xml = df.select(O.listing_xml(df, "Contents", "http://x/")).collect()[0][0]
    assert '<Contents xmlns="http://x/">' in xml and "<Key>a&amp;b</Key>" in xml and "<Size>1</Size>" in xml
    good = spark.createDataFrame([('[{"id":"w","events":["a"],"filter":{"prefix":"p"}}]',)], "value string")
    assert O.parsed_config(good, "value", O.WEBHOOKS).collect()[0].value[0].filter.prefix == "p"
    with pytest.raises(Exception):
        O.parsed_config(spark.createDataFrame([("nonsense",)], "value string"), "value", O.RULES).collect()
    path = tmp_path / "c.toml"
    path.write_text('poll_seconds = 5\nextra = 1\n[buckets]\nphotos = "/p"\n')
    found = load(str(path))
    assert (found.buckets, found.poll_seconds, found.other) == ({"photos": "/p"}, 5, {"extra": 1})


def test_union_and_presence(spark):
    a, b = spark.createDataFrame([("b", "k", 1)], "bucket string, key string, x int"), spark.createDataFrame([("c", "k")], "bucket string, key string")
    assert O.present(a, b).count() == 0 and O.present(a, a).count() == 1


def test_background_jobs(spark):
    jobs = Background(spark)
    done = jobs.wait(jobs.start(lambda: spark.range(10).count()), 60)
    assert (done.status, done.result) == ("complete", 10)
    assert jobs.wait(jobs.start(lambda: 1 / 0), 60).status == "failed" and jobs.get("none") is None
    slow = jobs.start(lambda: spark.range(0, 400, 1, 4).mapInPandas(lambda it: [(time.sleep(20), b)[1] for b in it], "id long").count())
    time.sleep(2)
    jobs.cancel(slow)
    assert jobs.wait(slow, 60).status == "cancelled"
