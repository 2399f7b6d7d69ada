import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalogue as C
from shelfmark.sources import files as S
from shelfmark.sources.changes import ChangesReader, TreeChanges
from shelfmark.sources.store import Versions
from shelfmark.streaming import jobs


def tree(root, **files):
    for key, text in files.items():
        path = root / key.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def listed(spark, root):
    spark.dataSource.register(S.FileTree)
    return spark.read.format("file_tree").option("bucket", "b").load(str(root))


def test_walk_facts_links_and_state(spark, tmp_path):
    tree(tmp_path, a="hello", d__b="hi", d__e__c="x", **{".shelfmark__x": "no"})
    os.symlink("gone", tmp_path / "d" / "link")
    rows = {r.key: r for r in listed(spark, tmp_path).collect()}
    assert sorted(rows) == ["a", "d/b", "d/e/c", "d/link"]
    assert (rows["d/b"].prefix, rows["d/b"].name, rows["d/b"].size, rows["d/b"].is_symlink) == ("d/", "b", 2, False)
    deep = spark.read.format("file_tree").option("bucket", "b").option("depth", "2").load(str(tmp_path))
    assert sorted(r.key for r in deep.collect()) == sorted(rows)
    assert rows["d/link"].symlink_target == "gone" and rows["a"].inode and rows["a"].mtime_ns == os.lstat(tmp_path / "a").st_mtime_ns


def test_hashing_files(spark, tmp_path):
    tree(tmp_path, a="hello world", d__b="hi")
    os.symlink("a", tmp_path / "link")
    got = {r.key: r for r in S.hashed(listed(spark, tmp_path), str(tmp_path)).collect()}
    assert sorted(got) == ["a", "d/b"] and got["a"].etag == '"5eb63bbbe01eeed093cb22bb8f5acdc3"' and got["a"].size == 11 and got["a"].readable
    inline = {r.key: bytes(r.content) for r in S.contents(spark, str(tmp_path)).collect()}
    assert inline["d/b"] == b"hi"
    part = spark.createDataFrame([(b"0123456789", 10)], "c binary, n long").select(S.slice_of(F.col("c"), F.lit("bytes=-3"), F.col("n"))).collect()[0][0]
    assert bytes(part) == b"789"
    assert S.valid_key("a/b") and not any(S.valid_key(k) for k in ("", "/a", "a/../b", ".shelfmark/x", None))


def test_writing_and_removing_files(spark, tmp_path):
    os.symlink("/tmp", tmp_path / "out")
    rows = spark.createDataFrame([("b", "d/x", b"1"), ("b", "../y", b"2"), ("b", "out/z", b"3"), ("b", "", b"4")], "bucket string, key string, content binary")
    done = {r.key: r.written for r in S.written(rows, str(tmp_path)).collect()}
    assert done == {"d/x": True, "../y": False, "out/z": False, "": False}
    assert (tmp_path / "d" / "x").read_bytes() == b"1" and not os.path.exists("/tmp/z")
    gone = {r.key: r.removed for r in S.removed(spark.createDataFrame([("b", "d/x"), ("b", "none"), ("b", "../y")], "bucket string, key string"), str(tmp_path)).collect()}
    assert gone == {"d/x": True, "none": True, "../y": False} and not (tmp_path / "d" / "x").exists()


def test_rescan(spark, tmp_path):
    tree(tmp_path, keep="1", edit="2", move="33", gone="4")
    before = spark.createDataFrame(listed(spark, tmp_path).toPandas(), S.SCHEMA)
    os.rename(tmp_path / "move", tmp_path / "moved")
    os.remove(tmp_path / "gone")
    tree(tmp_path, edit="changed", fresh__new="5")
    got = {r.key: r["class"] for r in C.classify(before, listed(spark, tmp_path)).collect()}
    assert got == {"keep": "unchanged", "edit": "modified", "moved": "moved", "gone": "deleted", "fresh/new": "new"}


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.current() is None
    v.commit(spark.createDataFrame([("b", 1)], "bucket string, x int"))
    v.commit(v.read().withColumn("x", F.col("x") + 1))
    assert v.current() == 2 and v.read().collect()[0].x == 2 and v.read(1).collect()[0].x == 1
    os.makedirs(tmp_path / "t" / "v=3")  # left unfinished
    assert v.current() == 2 and v.commit(v.read().limit(0)) == 3 and v.read().count() == 0
    assert v.expire(1) == [1, 2] and v.versions() == [3]


COLUMNS = "bucket string, prefix string, name string, key string, id string, size long, file_mtime_ns long, scan_level int, etag string, last_modified_ns long, created_at_ns long"


def test_change_stream_keeps_a_catalogue_current(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, a="1", d__b="22")
    table = Versions(spark, str(tmp_path / "catalogue"))
    table.commit(spark.createDataFrame([], COLUMNS))
    spark.dataSource.register(TreeChanges)

    def step():
        stream = spark.readStream.format("tree_changes").option("bucket", "b").option("state", str(tmp_path / "state")).load(str(root))
        jobs.follow(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
        return {r.key: (r.size, r.scan_level) for r in table.read().collect()}

    first = step()
    assert first == {"a": (1, 1), "d/b": (2, 1)}
    tree(root, a="111", c="4")
    os.remove(root / "d" / "b")
    assert step() == {"a": (3, 1), "c": (1, 1)}


def test_changes_of_parts_and_of_what_is_being_written(tmp_path):
    import threading
    import time

    root = tmp_path / "root"
    tree(root, top="1", a__x="1", a__b__y="2", c__z="3")
    reader = ChangesReader({"path": str(root), "bucket": "b", "state": str(tmp_path / "state"), "debounce_ms": "50"})

    def changes(start):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        rows = [r for p in parts for r in reader.read(p)]
        assert rows == [r for p in reader.partitions(start, end) for r in reader.read(p)]  # a batch that is run again
        return sorted(r[1:3] for r in rows), end

    first, at = changes(reader.initialOffset())
    assert first == [("a/b/y", "changed"), ("a/x", "changed"), ("c/z", "changed"), ("top", "changed")]
    assert len(reader.partitions({"listing": 0}, at)) == 3
    os.remove(root / "c" / "z")
    os.rmdir(root / "c")
    tree(root, a__x="longer", d__new="4")
    second, at = changes(at)
    assert second == [("a/x", "changed"), ("c/z", "deleted"), ("d/new", "changed")]
    assert changes(at)[0] == []
    reader.commit(at)
    assert all(int(n.split(".")[0]) >= at["listing"] for n in os.listdir(tmp_path / "state"))

    def write():
        for n in range(8):
            (root / "top").write_text("x" * (n + 2))
            time.sleep(0.02)

    (root / "top").write_text("x")
    worker = threading.Thread(target=write)
    worker.start()
    end = reader.latestOffset()
    sizes = [r[3] for p in reader.partitions(at, end) for r in reader.read(p) if r[1] == "top"]
    worker.join()
    assert sizes == [9]


def test_false_alarms_leave_rows_alone(spark):
    held = spark.createDataFrame([("b", "", "a", "a", "1", 5, 7, 3, "e", 1, 1), ("b", "", "x", "x", "2", 5, 7, 3, "e", 1, 1)], COLUMNS)
    change = spark.createDataFrame([("b", "a", "changed", 5, 7), ("b", "x", "deleted", None, None), ("b", "x", "changed", 6, 8)], "bucket string, key string, op string, size long, mtime_ns long")
    got = {r.key: (r.scan_level, r.etag, r.size) for r in jobs.applied(held, change, 99).collect()}
    assert got == {"a": (3, "e", 5), "x": (1, None, 6)}


def test_object_stream_and_late_events(spark, tmp_path):
    schema = "bucket string, object_key string, object_id string, event_time long, event_id long, removed boolean"
    folder = tmp_path / "in"
    table = Versions(spark, str(tmp_path / "t"))

    def step(rows, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"n={n}"))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        jobs.follow_objects(stream, table, str(tmp_path / "c")).awaitTermination()
        return {r.object_key: r.object_id for r in jobs.live(table).collect()}

    assert step([("b", "a", "1", 5, 1, False), ("b", "z", "2", 9, 2, True)], 1) == {"a": "1"}
    assert step([("b", "a", "0", 4, 3, True), ("b", "z", "2", 8, 4, False), ("b", "n", "3", 1, 5, False)], 2) == {"a": "1", "n": "3"}


def test_delivery_retries_and_logs(spark, tmp_path):
    schema = "event_id long, event_name string, bucket string, object_key string, event_time timestamp"
    spark.sql("select 1L event_id, 's3:ObjectCreated:Put' event_name, 'b' bucket, 'k.jpg' object_key, timestamp'2025-01-01' event_time").write.parquet(str(tmp_path / "in"))
    hooks = spark.createDataFrame([("b", "w", "http://fails", ["s3:*"], None), ("b", "v", "http://works", ["s3:*"], (None, ".jpg"))], "bucket string, id string, url string, events array<string>, filter struct<prefix:string,suffix:string>")

    def send(url, job):
        if "fails" in url:
            raise OSError("no route")

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.deliver(stream, hooks, send, str(tmp_path / "log"), str(tmp_path / "c"), waits=(0.0, 0.0)).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r.id, r.status) for r in log) == [("v/1/1", "delivered"), ("w/1/1", "failed"), ("w/1/2", "failed"), ("w/1/3", "failed")]


def test_cleaning_and_progress(spark, tmp_path):
    from datetime import datetime

    uploads, parts = Versions(spark, str(tmp_path / "u")), Versions(spark, str(tmp_path / "p"))
    uploads.commit(spark.createDataFrame([("b", "old", "k", datetime(2025, 1, 1)), ("b", "new", "k", datetime(2025, 3, 1))], "bucket string, id string, key string, initiated_at timestamp"))
    parts.commit(spark.createDataFrame([("old", 1, "e", datetime(2025, 1, 1), "p", 5), ("new", 1, "e", datetime(2025, 1, 1), "q", 7)], "upload_id string, part_number int, etag string, uploaded_at timestamp, id string, size long"))
    assert jobs.clean_uploads(uploads, parts, datetime(2025, 2, 1)) == {"uploads": 1, "bytes": 5}
    assert jobs.clean_uploads(uploads, parts, datetime(2025, 2, 1)) == {"uploads": 0, "bytes": 0}
    assert [r.id for r in uploads.read().collect()] == ["new"] and [r.upload_id for r in parts.read().collect()] == ["new"]
    spark.range(3).write.parquet(str(tmp_path / "in"))
    query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(lambda b, n: b.count()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert (jobs.progress(query)["running"], jobs.progress(query)["numInputRows"], jobs.progress(query)["error"]) == (False, 3, None)


def test_batches_until_nothing_is_pending(spark, tmp_path):
    from shelfmark.operators.catalogue import enriched

    table = Versions(spark, str(tmp_path / "t"))
    table.commit(spark.range(7).select(F.lit("b").alias("bucket"), F.lit("").alias("prefix"), F.concat(F.lit("k"), "id").alias("name"), F.concat(F.lit("k"), "id").alias("key"), F.lit(10).cast("long").alias("size"), F.lit(1).alias("scan_level")))
    step = lambda batch: table.commit(enriched(table.read(), batch.select("bucket", "key", "size"), 2))
    assert jobs.pending_batches(table.read, 2, step, 20) == 4
    assert table.read().filter("scan_level < 2").count() == 0


def test_batches_go_on_past_1000_and_past_files_that_stay_below(spark, monkeypatch):
    def pending(n):
        return spark.range(n).selectExpr("if(id % 2 = 0, 'b', 'c') bucket", "'' prefix", "lpad(id, 5, '0') name", "lpad(id, 5, '0') key", "10L size", "1 scan_level").coalesce(1).cache()

    stuck, seen = pending(5), []
    assert jobs.pending_batches(lambda: stuck, 2, lambda batch: seen.append(sorted(r.key for r in batch.collect())) if len(seen) < 9 else 1 / 0, 10) == 3
    assert seen == [["00000", "00001"], ["00002", "00003"], ["00004"]]

    class Batch:
        def __init__(self, n):
            self.n = n

        def isEmpty(self):
            return self.n == 0

        def __getattr__(self, name):
            return lambda *args, **more: self

    turns, steps = iter(range(1002, -1, -1)), []
    monkeypatch.setattr(jobs, "byte_budget", lambda *args: Batch(next(turns)))
    monkeypatch.setattr(jobs, "materialise", lambda df: df)
    monkeypatch.setattr(jobs.F, "broadcast", lambda df: df)
    assert jobs.pending_batches(lambda: Batch(1), 2, steps.append, 10) == 1002 == len(steps)


def test_links_on_the_way_are_refused(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    tree(root, a="1")
    tree(outside, f="kept")
    os.symlink(outside, root / "ln")
    keys = spark.createDataFrame([("b", "ln/f"), ("b", "a"), ("b", "../outside/f"), ("b", "gone/x")], "bucket string, key string")
    assert {r.key: r.removed for r in S.removed(keys, str(root)).collect()} == {"ln/f": False, "a": True, "../outside/f": False, "gone/x": True}
    assert (outside / "f").read_text() == "kept"
    assert [(r.key, r.readable) for r in S.hashed(keys.filter("key = 'ln/f'"), str(root)).collect()] == [("ln/f", False)]


def test_content_of_files_and_links(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, a="text")
    os.symlink("a", root / "ln")
    keys = spark.createDataFrame([("b", "a", 1), ("b", "ln", 2), ("b", "gone", 3), ("b", "../x", 4)], "bucket string, key string, size int")
    got = {r.key: r.content and bytes(r.content) for r in S.fetched(keys, str(root)).collect()}
    assert got == {"a": b"text", "ln": b"a", "gone": None, "../x": None}


def test_an_attempt_that_hangs_fails_in_time():
    import time

    with pytest.raises(TimeoutError):
        jobs.timed(lambda url, job: time.sleep(5), "u", {}, 0.05)
    with pytest.raises(KeyError):
        jobs.timed(lambda url, job: {}["x"], "u", {}, 5)
    jobs.timed(lambda url, job: None, "u", {}, 5)


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_changes_cost_what_they_change(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"), keep=2)
    line = "bucket string, key string, n int"
    many = spark.range(20_000).select(F.lit("b").alias("bucket"), F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit(0).alias("n"))
    v.commit(many)
    whole, want = size_of(v.path), {r.key: r.n for r in many.collect()}
    keys = sorted(want)
    for step in range(1, 21):
        gone, put = keys[step], keys[100 + step % 3]
        before = set(os.listdir(v.path))
        v.amend(spark.createDataFrame([("b", put, step), ("b", f"new{step}", step)], line), spark.createDataFrame([("b", gone)], "bucket string, key string"))
        assert sum(size_of(os.path.join(v.path, n)) for n in set(os.listdir(v.path)) - before) < whole / 20
        want |= {put: step, f"new{step}": step}
        want.pop(gone)
    assert {r.key: r.n for r in v.read().collect()} == want and v.read().count() == len(want)
    assert len([n for n in os.listdir(v.path) if n.startswith("d=")]) < 20 and len(v.versions()) == 2
    now = v.current()
    assert v.amend(many.limit(0)) == now == v.current()
    assert v.changed_since(now).count() == 0
    v.amend(spark.createDataFrame([("b", "x", 1)], line))
    assert [r.key for r in v.changed_since(now).collect()] == ["x"]
    v.amend(many.withColumn("n", F.lit(-7)))  # more than a fourth: all goes into a new base
    assert v.changed_since(now) is None and v.read().filter("n = -7").count() == 20_000 and not [n for n in os.listdir(v.path) if n.startswith("d=") and int(n[2:]) > now + 2]


def test_a_version_that_was_left_unfinished_is_overwritten(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    v.commit(spark.createDataFrame([("b", f"k{n}", 1) for n in range(50)], "bucket string, key string, n int"))
    os.makedirs(os.path.join(v.path, "d=2"))
    open(os.path.join(v.path, "d=2", "part-junk.parquet"), "w").write("junk")
    assert v.read().count() == 50
    v.amend(spark.createDataFrame([("b", "k1", 2)], "bucket string, key string, n int"))
    assert v.read().filter("n = 2").count() == 1 and v.read(1).filter("n = 2").count() == 0
