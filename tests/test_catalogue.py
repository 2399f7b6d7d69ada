import base64
import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.scalars import key_name, key_prefix
from shelfmark.operators import catalogue as C
from shelfmark.operators import duplicates as U
from shelfmark.operators import integrity as I
from shelfmark.operators import listing as L
from shelfmark.operators import matching as M
from shelfmark.operators import multipart as P
from shelfmark.operators import stats as T
from shelfmark.operators import tags as G


def files(spark, rows):
    """rows: (key, hash, size, level)."""
    df = spark.createDataFrame([("b", *r, *[None] * (4 - len(r))) for r in rows], "bucket string, key string, checksum_sha256 string, size long, scan_level int")
    return df.withColumns({"prefix": key_prefix(F.col("key")), "name": key_name(F.col("key")), "id": F.concat(F.lit("id-"), "key")})


def keys(df, column="key"):
    return [r[column] for r in df.collect()]


def test_prefix_and_children(spark):
    df = files(spark, [("photos/b.jpg",), ("photos/a.jpg",), ("docs/readme.md",), ("photos/sub/c.jpg",), ("zz.txt",), ("phot",)])
    assert keys(L.page(df, 10, "photos/")) == ["photos/a.jpg", "photos/b.jpg", "photos/sub/c.jpg"]
    assert keys(L.page(df, 2)) == ["phot", "zz.txt"]
    assert keys(L.page(df, 2, after=("", "zz.txt"))) == ["docs/readme.md", "photos/a.jpg"]
    assert sorted(keys(L.children(df, "photos"))) == ["photos/a.jpg", "photos/b.jpg"] and sorted(keys(L.children(df, ""))) == ["phot", "zz.txt"]
    assert [r.key for r in L.stream(df, "photos/", ("photos/", "a.jpg"))] == ["photos/b.jpg", "photos/sub/c.jpg"]
    with pytest.raises(ValueError):
        L.page(df, 0)


def test_partial_prefix_does_not_reach_other_directories(spark):
    df = files(spark, [("photos/aa/x",), ("photos/va/y",), ("photos/vb",)])
    assert sorted(keys(L.page(df, 9, "photos/va"))) == ["photos/va/y"]


def test_pages_of_entries_lose_and_repeat_nothing(spark):
    df = files(spark, [(k,) for k in ("a", "b/1", "b/2", "c", "c/1", "d/e/f", "e", "é")])
    seen, token = [], None
    while True:
        rows = sorted(L.entries_page(df, 2, token=token).collect(), key=lambda r: r.entry)
        seen += [r.entry for r in rows]
        if not rows or not rows[0].has_more:
            break
        token = L.encode_token(rows[-1].entry)
    assert seen == ["a", "b/", "c", "c/", "d/", "e", "é"]
    assert L.decode_token("!bad") is None and L.decode_token(L.encode_token("x é")) == "x é"
    assert L.entries_page(df, 5, "none/").collect() == []


def test_entries_of_buckets_stay_apart(spark):
    b = files(spark, [("a", "h", 1), ("d/x", "h", 2), ("e", "h", 3)])
    df = b.unionByName(files(spark, [("a", "h", 9), ("d/y", "h", 4)]).withColumn("bucket", F.lit("c")))
    wanted = [("b", "a", 1), ("b", "d/", None), ("b", "e", 3), ("c", "a", 9), ("c", "d/", None)]
    assert sorted((r.bucket, r.entry, r["size"] or None) for r in L.entries(df, within=["bucket"]).collect()) == wanted
    assert sorted((r.bucket, r.entry) for r in L.entries(df, delimiter="", within=["bucket"]).collect()) == [("b", "a"), ("b", "d/x"), ("b", "e"), ("c", "a"), ("c", "d/y")]
    seen, token = [], None
    while token is None or rows[0].has_more:
        rows = L.entries_page(df, 2, token=token, within=["bucket"]).collect()
        seen += [(r.bucket, r.entry, r["size"]) for r in sorted(rows, key=lambda r: (r.bucket, r.entry))]
        token = L.encode_token(seen[-1][1], seen[-1][0])
    assert seen == wanted


def test_groups(spark):
    df = files(spark, [("a/1", "h", 5), ("b/1", "h", 5), ("c/deep/er/1", "h", 5), ("d", "u", 1), ("e", None, 3), ("f", None, 3), ("n1", "z", None), ("n2", "z", None)])
    assert sorted((r.checksum_sha256, r.files, r.total_size, r.wasted_size) for r in U.groups(df).collect()) == [("h", 3, 15, 10), ("z", 2, 0, 0)]
    assert [r.files for r in U.groups(df, key_contains="DEEP").collect()] == [3]
    assert [r.files for r in U.groups(df, key_contains="deep", max_depth=1).collect()] == []
    assert len(U.groups(df, max_depth=0).collect()) == 2
    assert [r.checksum_sha256 for r in U.groups(df, key_contains="n_").collect()] == ["z"]
    assert sorted(keys(U.members(df, U.groups(df)))) == ["a/1", "b/1", "c/deep/er/1", "n1", "n2"]
    found = U.groups(df, within=[])
    first = U.groups_page(found, 1).collect()[0]
    assert keys(U.groups_page(found, 5, U.encode_group_token(first.total_size, first.checksum_sha256)), "checksum_sha256") == ["z"]
    assert U.decode_group_token("garbage!") is None and U.decode_group_token(U.encode_group_token(4096, "abc123")) == (4096, "abc123")


def test_many_equal_hashes_across_buckets(spark):
    df = spark.range(1200).select(F.concat(F.lit("b"), (F.col("id") % 3).cast("string")).alias("bucket"), F.lit("h").alias("checksum_sha256"), F.lit(1).alias("size"))
    assert [tuple(r) for r in U.cross_bucket_groups(df).collect()] == [("h", 1200, 1200, 3)]


def test_directory_hashes(spark):
    df = files(spark, [("photos/a.jpg", "aaa", 1), ("photos/.DS_Store", "x", 9), ("two/b.txt", "bbb", 1), ("two/a.txt", "aaa", 2), ("open/a", "aaa", 1), ("open/b", None, 1), ("junk/Thumbs.db", "x", 1), ("root", "r", 1)])
    got = {r.prefix: (r.dir_hash, r.file_count, r.total_size) for r in U.directory_hashes(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {"photos/": (sha("a.jpg:aaa\n"), 1, 1), "two/": (sha("a.txt:aaa\nb.txt:bbb\n"), 2, 3), "open/": (None, 2, 2), "junk/": (None, 0, 0)}


def test_directory_groups(spark):
    df = spark.createDataFrame([("b", "a/", "h", False, 2, 5), ("b", "c/d/", "h", False, 2, 5), ("b", "s/", "h", True, 2, 5), ("b", "e/", None, False, 2, 5)], "bucket string, prefix string, dir_hash string, stale boolean, file_count int, total_size long")
    found = U.directory_groups(df)
    assert [tuple(r) for r in found.collect()] == [("b", "h", 2, 2, 10)]
    assert sorted(keys(U.directory_members(df, found), "prefix")) == ["a/", "c/d/"]
    assert U.directory_groups(df, prefix="C/").count() == 1 and U.directory_groups(df, prefix="x").count() == 0 and U.directory_groups(df, min_files=3).count() == 0


def test_compare(spark):
    side = lambda rows: spark.createDataFrame(rows, "path string, checksum_sha256 string")
    out = U.compare(side([("same", "1"), ("mod", "1"), ("left", "1"), ("none", None)]), side([("same", "1"), ("mod", "2"), ("right", "1"), ("none", None)]))
    assert {r.path: r.status for r in out.collect()} == {"same": "identical", "mod": "modified", "left": "only_in_left", "right": "only_in_right", "none": "identical"}
    assert tuple(U.compare_summary(out).collect()[0]) == (2, 1, 1, 1, False)
    assert U.compare_summary(U.compare(side([]), side([]))).collect()[0].identical is False


def test_status_gate_and_budget(spark):
    df = files(spark, [("a", None, 10, 1), ("b", None, None, 2), ("c", None, 5, 2), ("d", None, 100, 3)])
    assert tuple(T.scan_status(df).collect()[0]) == ("b", 4, 1, 3, 25.0)
    with pytest.raises(T.ScanPending):
        T.require_complete(df, "b")
    T.require_complete(df, "empty")
    assert tuple(T.remaining(df).collect()[0]) == ("b", 3, 15)
    assert sorted(keys(T.byte_budget(df, 3, 10))) == ["a"] and sorted(keys(T.byte_budget(df, 3, 11))) == ["a", "b", "c"] and sorted(keys(T.byte_budget(df, 3, 1))) == ["a"]
    assert len(keys(T.byte_budget(df, 3, 1000, rows=2))) == 2
    samples = spark.createDataFrame([("x", 2, 20.0), ("x", 1, 10.0), ("x", 3, None)], "k string, o int, r double")
    assert T.throughput(samples, ["k"], "o", "r").collect()[0].rate == pytest.approx(13.0)


def test_bucket_stats(spark):
    dirs = spark.createDataFrame([("b", "p/", "h", False, 1, 1), ("b", "q/", "h", False, 1, 1)], "bucket string, prefix string, dir_hash string, stale boolean, file_count int, total_size long")
    df = files(spark, [("a", "h", 5), ("b", "h", 5), ("c", "h", 6), ("d", None, 7)])
    assert tuple(T.bucket_stats(df, dirs).collect()[0]) == ("b", 4, 23, 2, 16 - 5, 1)


def seen(spark, rows):
    return spark.createDataFrame([("b", *r) for r in rows], "bucket string, key string, inode long, device_id long, size long, created_at_ns long")


def classes(spark, old, new, **kw):
    return {r.key: (r["class"], r.old_key) for r in C.classify(seen(spark, [(*r, 0) for r in old] if len(old[0]) == 4 else old) if old else seen(spark, []), seen(spark, [(*r, 0) for r in new]), **kw).collect()}


def test_classes(spark):
    old = [("same", 1, 1, 5), ("null", None, None, None), ("mod", 2, 1, 5), ("from", 3, 1, 5), ("gone", 4, 1, 5)]
    new = [("same", 1, 1, 5), ("null", None, None, None), ("mod", 2, 1, 6), ("to", 3, 1, 5), ("fresh", 9, 1, 5)]
    assert classes(spark, old, new) == {"same": ("unchanged", None), "null": ("unchanged", None), "mod": ("modified", None), "to": ("moved", "from"), "gone": ("deleted", None), "fresh": ("new", None)}


def test_hard_links_and_reused_inodes_are_no_moves(spark):
    assert classes(spark, [("a", 1, 1, 5)], [("a", 1, 1, 5), ("b", 1, 1, 5)]) == {"a": ("unchanged", None), "b": ("new", None)}
    assert classes(spark, [("a", 1, 1, 5)], [("b", 1, 1, 6)]) == {"a": ("deleted", None), "b": ("new", None)}
    assert classes(spark, [("y", 1, 1, 5), ("x", 1, 1, 5)], [("q", 1, 1, 5), ("p", 1, 1, 5)]) == {"p": ("moved", "x"), "q": ("new", None), "y": ("deleted", None)}


def test_rows_newer_than_the_scan_survive(spark):
    got = classes(spark, [("old", 1, 1, 5, 10), ("young", 2, 1, 5, 99)], [], scan_start_ns=F.lit(50))
    assert got == {"old": ("deleted", None)}


def test_next_catalogue(spark):
    old = files(spark, [("a/x", "h", 5, 3), ("a/m", "h", 5, 3), ("a/g", "h", 5, 3)]).withColumns({"inode": F.when(F.col("key") == "a/x", 1).when(F.col("key") == "a/m", 2).otherwise(3).cast("long"), "device_id": F.lit(1).cast("long"), "created_at_ns": F.lit(1).cast("long"), "last_modified_ns": F.lit(1).cast("long"), "etag": F.lit("e")})
    disk = seen(spark, [("c/x", 1, 1, 5, 0), ("a/m", 2, 1, 6, 0), ("new", 9, 1, 7, 0)])
    out = {r.key: r for r in C.next_catalogue(old, disk, C.classify(old, disk), 77).collect()}
    assert sorted(out) == ["a/m", "c/x", "new"]
    assert (out["c/x"].id, out["c/x"].checksum_sha256, out["c/x"].last_modified_ns, out["c/x"].prefix) == ("id-a/x", "h", 77, "c/")
    assert (out["a/m"].scan_level, out["a/m"].checksum_sha256, out["a/m"].size, out["a/m"].id) == (1, None, 6, "id-a/m")
    assert (out["new"].scan_level, out["new"].created_at_ns, out["new"].name) == (1, 77, "new")


def test_upsert_keeps_id_and_birth(spark):
    schema = "bucket string, key string, id string, created_at_ns long, size long, etag string"
    old = spark.createDataFrame([("b", "test.txt", "1", 1, 100, "x"), ("b", "other", "2", 1, 1, "y")], schema)
    new = spark.createDataFrame([("b", "test.txt", "9", 5, 200, None, 1), ("b", "test.txt", "9", 5, 300, None, 0), ("b", "more", "3", 5, 7, "z", 1)], schema + ", at int")
    got = {r.key: tuple(r)[2:] for r in C.upsert(old, new, ["bucket", "key"], ["at"]).collect()}
    assert got == {"test.txt": ("1", 1, 200, None), "other": ("2", 1, 1, "y"), "more": ("3", 5, 7, "z")}


def test_rename_delete_copy_and_levels(spark):
    df = files(spark, [("a/x", "h", 1, 3), ("a/y", "h", 1, 1), ("z", "h", 1, 2)]).withColumns({"last_modified_ns": F.lit(1).cast("long"), "created_at_ns": F.lit(1).cast("long")})
    moves = spark.createDataFrame([("b", "a/x", "n/x"), ("b", "none", "q"), ("b", "a/y", "z")], "bucket string, old_key string, new_key string")
    assert {r.old_key: r.outcome for r in C.renames(df, moves).collect()} == {"a/x": "moved", "none": "no_such_key", "a/y": "exists"}
    assert {r.key: (r.id, r.prefix, r.last_modified_ns) for r in C.renamed(df, moves, 9).collect()} == {"n/x": ("id-a/x", "n/", 9), "a/y": ("id-a/y", "a/", 1), "z": ("id-z", "", 1)}
    assert {r.key: r.id for r in C.renamed(df, moves, 9, overwrite=True).collect()} == {"n/x": "id-a/x", "z": "id-a/y"}
    gone = spark.createDataFrame([("b", "z"), ("b", "z"), ("b", "nothing")], "bucket string, key string")
    assert sorted(keys(C.deleted(df, gone))) == ["a/x", "a/y"]
    assert {r.key: r.existed for r in C.bulk_delete(df, gone, C.BULK_LIMIT).collect()} == {"z": True, "nothing": False}
    with pytest.raises(ValueError):
        C.bulk_delete(df, gone, 1)
    up = spark.createDataFrame([("b", "a/x", 50), ("b", "a/y", 50)], "bucket string, key string, size long")
    assert {r.key: (r.size, r.scan_level) for r in C.enriched(df, up, 2).collect()} == {"a/x": (1, 3), "a/y": (50, 2), "z": (1, 2)}
    assert {r.key: r.scan_level for r in C.reset(df, up, 2).collect()} == {"a/x": 2, "a/y": 1, "z": 2}
    asked = spark.createDataFrame([("b", "z", "c", "d/z")], "bucket string, key string, to_bucket string, to_key string")
    copy = C.copies(df, asked, 9).collect()[0]
    assert (copy.bucket, copy.key, copy.prefix, copy.checksum_sha256, copy.created_at_ns) == ("c", "d/z", "d/", "h", 9)


def test_merge_plan(spark):
    df = files(spark, [("w", "h"), ("l", "h"), ("m", "other"), ("u", None)])
    asked = spark.createDataFrame([("id-w", f"id-{k}") for k in ("w", "l", "m", "u", "none")], "winner_id string, loser_id string")
    assert {r.loser_id: r.outcome for r in C.merge_plan(df, asked).collect()} == {"id-w": "same_object", "id-l": "delete", "id-m": "mismatch", "id-u": "scan_pending", "id-none": "no_such_key"}


def test_stale_directories(spark):
    before, after = files(spark, [("a/1", "h", 1), ("b/1", "h", 1), ("c/1", "h", 1), ("d/1", None, 1)]), files(spark, [("a/1", "h", 99), ("b/1", "i", 1), ("e/1", "h", 1), ("d/1", None, 1)])
    assert sorted(keys(C.stale_directories(before, after), "prefix")) == ["b/", "c/", "e/"]


def test_integrity(spark):
    held = spark.createDataFrame([("b", k, h, 10, 1) for k, h in (("good", "1"), ("bad", "1"), ("worse", "1"), ("gone", "1"), ("none", None), ("unread", "1"), ("touched", "1"))], "bucket string, key string, checksum_sha256 string, size long, file_mtime_ns long")
    disk = spark.createDataFrame([("b", "good", "1", 1, True), ("b", "bad", "2", 1, None), ("b", "worse", "2", 2, True), ("b", "unread", None, 1, False), ("b", "touched", "1", 9, True)], "bucket string, key string, checksum_sha256 string, mtime_ns long, readable boolean")
    out = I.verify(held, disk)
    assert {r.key: r.reason for r in out.collect()} == {"good": None, "bad": "content_mismatch_no_mtime_change", "worse": "content_mismatch_mtime_changed", "gone": "file_missing", "none": None, "unread": "read_error", "touched": None}
    assert tuple(I.rollup(out).collect()[0]) == ("b", 7, 3, 30, 4)


def test_multipart(spark):
    texts = ["Part 1: The quick brown fox\n", "Part 2: jumps over the lazy\n", "Part 3: dog.\n"]
    rows = [("u", n, f'"{hashlib.md5(t.encode()).hexdigest()}"', len(t)) for n, t in enumerate(texts, 1)] + [("v", 1, None, 3)]
    df = spark.createDataFrame(rows, "upload_id string, position int, etag string, size long")
    assert {r.upload_id: (r.etag, r.parts) for r in P.composite_etags(df).collect()} == {"u": ('"6bebfc14b9887a518f826495488a47d7-3"', 3), "v": (None, 1)}
    parts = spark.createDataFrame([("u", 1, "a", datetime(2025, 1, 1), "p1", 5), ("u", 1, "b", datetime(2025, 1, 2), "p2", 6), ("u", 2, "c", datetime(2025, 1, 1), "p3", 7)], "upload_id string, part_number int, etag string, uploaded_at timestamp, id string, size long")
    now = P.current_parts(parts)
    assert sorted((r.part_number, r.etag) for r in now.collect()) == [(1, "b"), (2, "c")]
    asked = spark.createDataFrame([("u", 1, "a"), ("u", 2, "c"), ("u", 3, "d")], "upload_id string, part_number int, etag string")
    assert {r.part_number: r.valid for r in P.check_request(asked, now).collect()} == {1: False, 2: True, 3: False}
    assert keys(P.parts_page(now, "u", after=1), "part_number") == [2]
    uploads = spark.createDataFrame([("b", "u", "A_1", datetime(2025, 1, 1)), ("b", "w", "ab1", datetime(2025, 3, 1)), ("b", "x", "a_1", datetime(2025, 3, 1))], "bucket string, id string, key string, initiated_at timestamp")
    assert keys(P.uploads_page(uploads, 9, "a_"), "id") == ["u", "x"] and keys(P.uploads_page(uploads, 9, "", "A_1", "u"), "id") == ["x", "w"] and P.uploads_page(uploads, 9, "", None, "u").count() == 0
    old = P.abandoned(uploads, now, datetime(2025, 2, 1))
    assert [tuple(r) for r in old.collect()] == [("u", "b", "A_1", 2, 13)]
    left = P.without(uploads, now, old)
    assert left[0].count() == 2 and left[1].count() == 0


def test_tags(spark):
    objects = spark.createDataFrame([("b", "1", "k1"), ("b", "2", "k2")], "bucket string, id string, key string")
    rows = [("b", "1", f"t{n}", "v") for n in range(11)] + [("b", "2", "é" * 65, "v"), ("b", "3", "t", "v")]
    tags = spark.createDataFrame(rows, "bucket string, object_id string, key string, value string")
    assert {r.object_id: r.problem for r in G.tag_problems(objects, tags).collect()} == {"1": "too_many_tags", "2": "key_too_long", "3": "no_such_object"}
    assert G.tags_of(objects, tags).count() == 12
    assert G.replaced(tags, tags.filter("object_id = '1'").limit(1)).count() == 3 and G.cleared(tags, tags.filter("object_id = '1'")).count() == 2


def test_patterns_and_conditions(spark):
    def match(patterns, name):
        return spark.createDataFrame([(patterns, name)], "p array<string>, n string").select(M.event_matches(F.col("p"), F.col("n"))).collect()[0][0]

    assert match(["s3:ObjectCreated:*"], "s3:ObjectCreated:Put") and not match(["s3:ObjectCreated:*"], "s3:ObjectRemoved:Delete")
    assert match(["x", "s3:ObjectCreated:Put"], "s3:ObjectCreated:Put") and not match(["s3:ObjectCreated:P"], "s3:ObjectCreated:Put") and not match([], "a")

    def origin(patterns, o):
        return spark.createDataFrame([(patterns, o)], "p array<string>, n string").select(M.origin_matches(F.col("p"), F.col("n"))).collect()[0][0]

    assert origin(["*"], "x") and origin(["https://*.example.com"], "https://a.example.com") and not origin(["https://*.example.com"], "http://a.example.com")
    assert not origin(["aa*aa"], "aaa") and origin(["http://a"], "http://a") and not origin(["http://a"], "http://b")

    none = F.lit(None)
    at = lambda n: F.lit(datetime(2025, 1, n))
    ask = lambda *c, **k: spark.range(1).select(M.condition(F.lit("e"), at(5), *c, **k)).collect()[0][0]
    assert ask(none, none, none, none) == "ok" and ask(F.lit("x"), F.lit("e"), none, none) == "failed" and ask(none, F.lit("e"), none, none) == "not_modified"
    assert ask(none, F.lit("e"), none, none, copying=True) == "failed" and ask(none, none, at(5), none) == "not_modified" and ask(none, none, at(4), at(4)) == "failed"
    bad = M.digest_mismatch({"md5": F.lit("a"), "sha": F.lit("b")}, {"md5": none.cast("string"), "sha": F.lit("c")})
    assert spark.range(1).select(bad).collect()[0][0] == "sha"


def test_buckets_compare_by_key_where_names_repeat(spark, tmp_path):
    from shelfmark.plans.registry import QUERIES

    h = {c: base64.b64encode(c.encode() * 32).decode() for c in "xyz"}
    rows = [("field-notes", "a/index.html", h["x"]), ("field-notes", "b/index.html", h["y"]), ("scan-archive", "a/index.html", h["x"]), ("scan-archive", "b/index.html", h["z"]), ("scan-archive", "c/index.html", h["x"])]
    made = [(f"{b}/{k}", b, k, k.split("/")[1], d) for b, k, d in rows]
    spark.createDataFrame(made, "id string, bucket string, key string, name string, checksum_sha256 string").write.parquet(str(tmp_path / "objects.parquet"))
    found = QUERIES["compare_buckets_by_key"](spark, str(tmp_path)).collect()
    assert sorted((r.key, r.status) for r in found) == [("a/index.html", "identical"), ("b/index.html", "modified"), ("c/index.html", "only_in_right")]


def test_pages_say_whether_there_are_more(spark):
    df = spark.createDataFrame([("b", f"{d}/", n, f"{d}/{n}", 1) for d in "ab" for n in "xyz"], "bucket string, prefix string, name string, key string, size long")
    seen, token = [], None
    while True:
        page = L.page_more(df, 4, "", token).orderBy("prefix", "name").collect()
        seen += [r.key for r in page]
        token = page[-1].next_token
        assert all(r.has_more is (token is not None) for r in page)
        if token is None:
            break
    assert seen == ["a/x", "a/y", "a/z", "b/x", "b/y", "b/z"]
    assert L.page_more(df, 6).first().has_more is False and L.page_more(df, 5, "", "no token").count() == 5 and L.page_more(df.limit(0), 5).count() == 0
    first = L.entries_page(df, 1, "", "/").collect()
    assert [(r.entry, r.has_more) for r in first] == [("a/", True)] and [r.entry for r in L.entries_page(df, 1, "", "/", first[0].next_token).collect()] == ["b/"]


def test_group_and_directory_tokens(spark):
    df = spark.createDataFrame([("b", h, 1) for h in ("h1", "h1", "h2", "h2", "h3", "h3")], "bucket string, checksum_sha256 string, size long")
    page = U.groups_page_more(U.cross_bucket_groups(df), 2).orderBy("checksum_sha256").collect()
    assert [r.checksum_sha256 for r in page] == ["h1", "h2"] and page[0].has_more
    assert [r.checksum_sha256 for r in U.groups_page_more(U.cross_bucket_groups(df), 2, page[0].next_token).collect()] == ["h3"]
    assert U.decode_directory_token(U.encode_directory_token("ab")) == "ab" and U.decode_directory_token("?") is None and U.decode_directory_token(None) is None
    dirs = spark.createDataFrame([(h * 40,) for h in "abc"], "dir_hash string")
    token = U.directories_page_more(dirs, 1).first().next_token
    assert [r.dir_hash[0] for r in U.directories_page_more(dirs, 5, token).orderBy("dir_hash").collect()] == ["b", "c"]


def test_cross_bucket_report_and_partial_answers(spark):
    df = spark.createDataFrame([(b, f"k{n}", h, 1, 3 if h else 1) for n, (b, h) in enumerate([("a", "h1"), ("b", "h1"), ("a", "h2"), ("a", "h2"), ("c", None), ("b", "h3")])], "bucket string, key string, checksum_sha256 string, size long, scan_level int")
    assert sorted((r.checksum_sha256, r.bucket, r.truncated) for r in U.cross_bucket_report(df, 1).collect()) == [("h1", "a", True), ("h1", "b", True)]
    assert {r.truncated for r in U.cross_bucket_report(df, 2).collect()} == {False}
    with pytest.raises(T.ScanPending):
        U.groups_so_far(df)
    assert [(r.bucket, r.checksum_sha256, r.scan_complete, r.pending) for r in U.groups_so_far(df, allow_partial=True).collect()] == [("a", "h2", True, 0)]
    assert U.groups_so_far(df.filter("bucket <> 'c'")).count() == 1


def test_lookups(spark):
    df = spark.createDataFrame([("b", "i1", "a/", "x", "a/x", 7, 1), ("b", "i2", "a/", "y", "a/y", 7, 1), ("c", "i3", "", "x", "x", None, None)], "bucket string, id string, prefix string, name string, key string, inode long, device_id long")
    assert L.get(df, "b", "a/y").first().id == "i2" and L.get(df, "c", "x").first().id == "i3" and L.get(df, "c", "a/x").count() == 0
    assert L.get_by_id(df, "i1").first().key == "a/x" and L.get_by_identity(df, "b", 7, 1).first().id == "i1" and L.get_by_identity(df, "c", 7, 1).count() == 0


def test_event_names_match_however_they_are_spelled(spark):
    hooks = spark.createDataFrame([("b", "w", "u", ["s3:ObjectCreated:*", " objectremoved:delete "], None), ("b", "all", "u", ["s3:*"], None), ("b", "none", "u", ["*"], None)], "bucket string, id string, url string, events array<string>, filter struct<prefix:string,suffix:string>")
    events = spark.createDataFrame([(n, "b", name, "k") for n, name in enumerate(["s3:ObjectCreated:Put", "ObjectCreated:Put", " S3:OBJECTREMOVED:DELETE", "s3:ObjectCreatedLater:x", "s3:ObjectRemoved:DeleteMarker"])], "event_id int, bucket string, event_name string, object_key string")
    got = sorted((r.webhook_id, r.event_id) for r in M.deliveries(events, hooks).collect())
    assert got == [("all", n) for n in range(5)] + [("w", n) for n in range(3)]


def test_members_of_one_content_come_in_order(spark):
    df = spark.createDataFrame([("b", "z/", "a", "h"), ("b", "", "c", "h"), ("a", "x/", "q", "h"), ("a", "x/", "p", "h"), ("a", "", "n", None), ("a", "", "m", "g")], "bucket string, prefix string, name string, checksum_sha256 string")
    assert [(r.bucket, r.prefix, r.name) for r in U.members_of(df, "h").collect()] == [("a", "x/", "p"), ("a", "x/", "q"), ("b", "", "c"), ("b", "z/", "a")]
    dirs = spark.createDataFrame([("b", "z/", "h", True), ("b", "a/", "h", False), ("b", "q/", None, False)], "bucket string, prefix string, dir_hash string, stale boolean")
    assert [r.prefix for r in U.directories_of(dirs, "h").collect()] == ["a/", "z/"]
