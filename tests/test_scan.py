import os

from pyspark.sql import functions as F

from shelfmark.functions.values import DEFAULT_CONTENT_TYPE
from shelfmark.operators.duplicates import directory_groups, groups
from shelfmark.operators.integrity import rollup, verify
from shelfmark.plans import scan
from shelfmark.sources.files import hashed
from shelfmark.sources.store import Versions
from shelfmark.streaming.background import Background


def write(root, **files):
    for key, text in files.items():
        path = root / key.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def rows(table):
    return {r.key: r for r in table.read().collect()}


def test_a_tree_from_nothing_to_duplicates(spark, tmp_path):
    root = tmp_path / "root"
    write(root, a__x_dot_txt="same", a__y_dot_jpg="other", b__x_dot_txt="same", b__y_dot_jpg="other", c="same")
    os.symlink("c", root / "link")
    table, dirs = Versions(spark, str(tmp_path / "t")), Versions(spark, str(tmp_path / "d"))
    assert scan.refresh(table, dirs, str(root), "b")["new"] == 6
    found = rows(table)
    assert {k: r.scan_level for k, r in found.items()} == dict.fromkeys(["a/x.txt", "a/y.jpg", "b/x.txt", "b/y.jpg", "c", "link"], 3)
    assert found["a/x.txt"].content_type == "text/plain" and found["c"].content_type == DEFAULT_CONTENT_TYPE
    assert found["link"].checksum_sha256 is None and found["link"].symlink_target == "c" and found["c"].file_mtime_ns == os.lstat(root / "c").st_mtime_ns
    assert sorted(r.files for r in groups(table.read()).collect()) == [2, 3]
    assert [r.directories for r in directory_groups(dirs.read()).collect()] == [2]

    again = scan.refresh(table, dirs, str(root), "b")
    assert (again["new"], again["unchanged"], again["deleted"]) == (0, 6, 0)

    os.rename(root / "a" / "x.txt", root / "a" / "z.txt")
    os.remove(root / "b" / "y.jpg")
    write(root, c="changed", d__new="fresh")
    os.utime(root / "c", ns=(1, 1))
    report = scan.find(table, str(root), "b")
    assert {k: report[k] for k in ("new", "unchanged", "modified", "moved", "deleted")} == {"new": 1, "unchanged": 3, "modified": 1, "moved": 1, "deleted": 1}
    after = rows(table)
    assert after["a/z.txt"].id == found["a/x.txt"].id and after["a/z.txt"].checksum_sha256 == found["a/x.txt"].checksum_sha256 and after["a/z.txt"].scan_level == 3
    assert (after["c"].scan_level, after["c"].checksum_sha256, after["d/new"].scan_level) == (1, None, 1)
    assert scan.stat(table, str(root), "b") == 2 and rows(table)["c"].file_mtime_ns == 1
    assert scan.digest(table, str(root), "b", budget=1) == 1 and scan.digest(table, str(root), "b") == 1 and scan.digest(table, str(root), "b") == 0
    assert all(r.scan_level == 3 for r in rows(table).values())

    write(root, d__new="tampered")
    files = hashed(table.read().filter("not is_symlink"), str(root))
    out = verify(table.read(), files)
    assert {r.key: r.reason for r in out.filter("reason is not null").collect()} == {"d/new": "content_mismatch_mtime_changed"}
    assert rollup(out).collect()[0].files_ok == 5


def test_a_subtree_leaves_the_rest_alone(spark, tmp_path):
    root = tmp_path / "root"
    write(root, a__x="1", b__y="2")
    table = Versions(spark, str(tmp_path / "t"))
    scan.find(table, str(root), "b")
    os.remove(root / "a" / "x")
    os.remove(root / "b" / "y")
    assert scan.find(table, str(root), "b", subtree="a/")["deleted"] == 1
    assert list(rows(table)) == ["b/y"]


def test_rows_of_an_upload_during_the_scan_stay(spark, tmp_path):
    root = tmp_path / "root"
    write(root, a="1")
    table = Versions(spark, str(tmp_path / "t"))
    scan.find(table, str(root), "b", now_ns=100)
    late = table.read().withColumns({"key": F.lit("up"), "name": F.lit("up"), "id": F.lit("u"), "created_at_ns": F.lit(999).cast("long")})
    table.commit(table.read().unionByName(late))
    assert scan.find(table, str(root), "b", now_ns=500)["deleted"] == 0
    assert sorted(rows(table)) == ["a", "up"]


def test_a_file_changed_since_its_stat_goes_back(spark, tmp_path):
    root = tmp_path / "root"
    write(root, a="1")
    table = Versions(spark, str(tmp_path / "t"))
    scan.find(table, str(root), "b")
    scan.stat(table, str(root), "b")
    os.utime(root / "a", ns=(5, 5))
    assert scan.digest(table, str(root), "b") == 1
    assert (rows(table)["a"].scan_level, rows(table)["a"].checksum_sha256) == (1, None)


def test_files_gone_since_their_stat_hold_nothing_up(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    write(root, a="1", b="2", c="3", d__e="4")
    table, dirs = Versions(spark, str(tmp_path / "t")), Versions(spark, str(tmp_path / "d"))
    stat = scan.stat

    def then_gone(*args):
        found = stat(*args)
        os.remove(root / "a")
        os.remove(root / "b")
        os.symlink("c", root / "b")
        return found

    budget = scan.byte_budget
    monkeypatch.setattr(scan, "stat", then_gone)
    monkeypatch.setattr(scan, "byte_budget", lambda files, level, size, most: budget(files, level, size, 1))
    scan.refresh(table, dirs, str(root), "b")
    assert {k: (r.scan_level, r.checksum_sha256 is None) for k, r in rows(table).items()} == {"a": (1, True), "b": (1, True), "c": (3, False), "d/e": (3, False)}
    assert [r.dir_hash is None for r in dirs.read().collect()] == [False]
    monkeypatch.undo()
    scan.refresh(table, dirs, str(root), "b")
    assert {k: (r.scan_level, r.is_symlink) for k, r in rows(table).items()} == {"b": (3, True), "c": (3, False), "d/e": (3, False)}


def test_all_levels_report(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    write(root, a="12", b="345", c="6", d="7")
    os.symlink("a", root / "link")
    table, dirs = Versions(spark, str(tmp_path / "t")), Versions(spark, str(tmp_path / "d"))
    find, stat = scan.find, scan.stat

    def then(step, change):
        def run(*args, **more):
            out = step(*args, **more)
            change()
            return out

        return run

    monkeypatch.setattr(scan, "find", then(find, lambda: os.remove(root / "d")))
    monkeypatch.setattr(scan, "stat", then(stat, lambda: (os.remove(root / "c"), os.utime(root / "b", ns=(1, 1)))))
    report = scan.refresh(table, dirs, str(root), "b")
    assert {k: report[k] for k in ("new", "updated", "errors", "hashed", "bytes", "skipped")} == {"new": 5, "updated": 4, "errors": 1, "hashed": 1, "bytes": 2, "skipped": 3}
    monkeypatch.undo()
    report = scan.refresh(table, dirs, str(root), "b")
    assert report == {"new": 0, "unchanged": 3, "modified": 0, "moved": 0, "deleted": 2, "updated": 1, "errors": 0, "skipped": 0, "hashed": 1, "bytes": 3}


def test_what_comes_to_a_place_later_is_another_object(spark, tmp_path):
    root = tmp_path / "root"
    write(root, x="first")
    table = Versions(spark, str(tmp_path / "t"))
    scan.find(table, str(root), "b", now_ns=1)
    first = rows(table)["x"].id
    os.rename(root / "x", root / "z")
    scan.find(table, str(root), "b", now_ns=2)
    write(root, x="second")
    scan.find(table, str(root), "b", now_ns=3)
    found = rows(table)
    assert found["z"].id == first and found["x"].id != first


def test_a_refresh_writes_and_hashes_what_changed(spark, tmp_path):
    root = tmp_path / "root"
    for n in range(40):
        write(root, **{f"d{n:02d}__f": f"text {n}"})
    table, dirs = Versions(spark, str(tmp_path / "t")), Versions(spark, str(tmp_path / "d"))
    scan.refresh(table, dirs, str(root), "b")
    base = dirs.note()
    write(root, d03__g="more")
    os.remove(root / "d04" / "f")
    scan.refresh(table, dirs, str(root), "b")
    assert dirs.note() > base and sorted(r.key for r in table.changed_since(base).collect()) == ["d03/g", "d04/f"]
    assert sorted(r.prefix for r in dirs.changed_since(1).collect()) == ["d03/", "d04/"]
    found = {r.prefix: r.file_count for r in dirs.read().collect()}
    assert found == {f"d{n:02d}/": 2 if n == 3 else 1 for n in range(40) if n != 4}


def test_all_that_waits_is_hashed_in_batches(spark, tmp_path):
    root = tmp_path / "root"
    for n in range(12):
        write(root, **{f"f{n}": "x" * n})
    table = Versions(spark, str(tmp_path / "t"))
    scan.find(table, str(root), "b")
    scan.stat(table, str(root), "b")
    os.remove(root / "f3")
    report = {}
    assert scan.digest_all(table, str(root), "b", most=5, report=report) == 3 and scan.digest_all(table, str(root), "b") == 0
    assert report["hashed"] == 11 and report["skipped"] == 1 and report["bytes"] == sum(n for n in range(12) if n != 3)
    assert {k: r.scan_level for k, r in rows(table).items()} == {f"f{n}": 1 if n == 3 else 3 for n in range(12)}


def test_sync_returns_at_once_and_does_not_hash(spark, tmp_path):
    root = tmp_path / "root"
    write(root, a="1", d__b="2")
    jobs, table = Background(spark), Versions(spark, str(tmp_path / "t"))
    done = jobs.wait(scan.sync(jobs, table, Versions(spark, str(tmp_path / "d")), str(root), "b"), 120)
    assert (done.status, done.result["new"], done.result["updated"]) == ("complete", 2, 2)
    assert {k: (r.scan_level, r.checksum_sha256) for k, r in rows(table).items()} == {"a": (2, None), "d/b": (2, None)}


def test_work_that_is_done_regularly(spark):
    jobs, times = Background(spark), []
    id = jobs.every(lambda: times.append(spark.range(3).count()) or len(times), 0.05)
    while len(times) < 3:
        jobs.wait(id, 0.05)
    jobs.cancel(id)
    jobs.wait(id, 30)
    assert jobs.get(id).status == "cancelled" and jobs.get(id).result >= 3 and set(times) == {3}
