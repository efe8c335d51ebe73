"""Small cases with known answers."""

import os

import pytest
from pyspark.sql import functions as F

from dupscope.functions import paths, rules, text
from dupscope.operators import diff, dirs, files, groups, panels, plan, ranks, sessions
from dupscope.sources.store import Store
from dupscope.sources.walker import Walk, hashed

FILE = "path string, size long, hash string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_grouping_and_rank(spark):
    m = spark.createDataFrame([("/a", 100, "h1"), ("/b", 100, "h1"), ("/c", 100, "h1"), ("/d", 50, "h2"), ("/e", 50, "h2"), ("/f", 200, "h3"), ("/g", 7, None)], FILE)
    assert rows(groups.summaries(m), "rank", "hash", "file_count", "reclaim") == [(0, "h1", 3, 200), (1, "h2", 2, 50)]
    assert rows(files.candidates(m.withColumn("hash", F.lit(None).cast("string"))), "path") == [("/a",), ("/b",), ("/c",), ("/d",), ("/e",)]


def test_twin_directories(spark):
    m = spark.createDataFrame([("/x/a/f1", 100, "1"), ("/x/a/f2", 200, "2"), ("/x/b/f1", 100, "1"), ("/x/b/f2", 200, "2"), ("/x/c/f1", 100, "1")], FILE)
    flat, tree = dirs.groups(dirs.signatures(m)).collect(), dirs.groups(dirs.merkle(m)).collect()
    assert [(r.paths, r.file_count, r.size_per_dir) for r in flat] == [(["/x/a", "/x/b"], 2, 300)] == [(r.paths, r.file_count, r.size_per_dir) for r in tree]
    more = m.union(spark.createDataFrame([("/x/b/z", 5, None)], FILE))
    assert not [r for r in dirs.groups(dirs.signatures(more)).collect() if "/x/b" in r.paths]


def test_incomplete_ancestors(spark):
    m = spark.createDataFrame([("/p/a/x", 1, "1"), ("/p/a/sub/deep", 1, None), ("/p/b/x", 1, "1")], FILE)
    assert rows(dirs.signatures(m, only_twins=False), "dir") == [("/p/b",)] == rows(dirs.merkle(m), "dir")
    assert rows(dirs.signatures(spark.createDataFrame([("/foo", 1, "1")], FILE), only_twins=False), "dir") == [("/",)]


def test_prefix_and_roots(spark):
    m = spark.createDataFrame([("/x/a", 100, "1"), ("/x/b", 200, "2"), ("/x2/c", 999, "3")], FILE)
    assert m.where(paths.below(F.col("path"), "/x")).agg(F.sum("size")).first()[0] == 300
    assert m.where(paths.below(F.col("path"), "/")).count() == 3
    assert m.where(paths.under_root(F.col("path"), "/x")).count() == 2


SNAP = "path string, size long, mtime long, device long, inode long, hash string"


@pytest.mark.parametrize(
    ("old", "new", "kinds"),
    [
        ([("/x/a", 9, 1, 1, 7, None)], [("/x/b", 9, 1, 1, 7, None)], {"moved_inode": 1}),
        ([("/x/a", 9, 1, 1, 7, "h")], [("/x/b", 9, 1, 2, 8, "h")], {"moved_hash": 1}),
        ([("/x/keep", 9, 1, 1, 7, "h")], [("/x/keep", 9, 1, 1, 7, "h"), ("/x/copy", 9, 1, 1, 8, "h")], {"unchanged": 1, "new_dup": 1}),
        ([("/x/a", 9, 1, 1, 7, "h")], [("/x/b", 8, 1, 1, 8, "g")], {"deleted": 1, "new": 1}),
        ([("/x/a", 9, 1, 1, 7, "h"), ("/x2/s", 9, 1, 1, 8, "g")], [("/x/a", 9, 1, 1, 7, "h")], {"unchanged": 1}),
    ],
)
def test_diff(spark, old, new, kinds):
    out = diff.changes(spark.createDataFrame(old, SNAP), spark.createDataFrame(new, SNAP), "/x")
    assert {r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()} == kinds


def test_plan_needs_keeper_and_target(spark):
    m = spark.createDataFrame([("/a1", 1, "A", 1, 1), ("/a2", 1, "A", 1, 2), ("/b1", 1, "B", 1, 3), ("/c1", 1, "C", 1, 4), ("/a3", 1, "A", 1, 1)], "path string, size long, hash string, device long, inode long")
    marks = spark.createDataFrame([("/a1", True, None), ("/a2", False, "delete"), ("/a3", False, "delete"), ("/b1", True, None), ("/c1", False, "delete")], "path string, is_keeper boolean, action string")
    assert rows(plan.rows(m, marks), "target", "keeper") == [("/a2", "/a1")]
    kept = plan.set_keeper(marks, m.where("hash = 'A'"), "/a2")
    assert rows(kept, "path", "is_keeper", "action") == [("/a2", True, None), ("/a3", False, "delete"), ("/b1", True, None), ("/c1", False, "delete")]
    marked = plan.mark(marks, spark.createDataFrame([(0, "/c1"), (1, "/c2"), (2, "/c3")], "place int, path string"), "/c3", "delete")
    assert set(rows(marked, "path", "is_keeper", "action")) >= {("/c1", True, "delete"), ("/c3", False, "delete")}
    assert sorted(rows(plan.mark(marks, m.where("hash = 'A'").withColumn("place", F.col("path")), "/a1", "delete"), "path")) == sorted(rows(marks, "path"))
    assert plan.reconcile(marks, plan.rows(m, marks), cancelled=False).count() == 0


def test_status_table(spark):
    cases = [(False, None, 0, 1, 1), (True, None, 0, 1, 2), (True, None, 0, 1, 1), (True, "h", 2, 2, 1), (True, "h", 2, 1, 1), (True, "h", 1, 1, 1)]
    df = spark.createDataFrame(cases, "s boolean, h string, c long, d long, t long")
    got = [r[0] for r in df.select(rules.dedup_status(*map(F.col, "shcdt"))).collect()]
    assert got == ["not_in_scan", "likely_duplicate", "unhashed", "dangerous_dup", "verified_dup", "hashed_unique"]


def test_inheritance(spark):
    key = list(files.IDENTITY)
    old = spark.createDataFrame([("/a", 1, 2, 3, 4, 5, "new", 1, 2), ("/a", 1, 2, 3, 4, 5, "old", 1, 1), ("/b", 1, 2, 3, 4, 5, "x", 0, 2)], ", ".join([f"{k} {'string' if k == 'path' else 'long'}" for k in key] + ["hash string", "identity_version long", "scan_id long"]))
    new = old.where("scan_id = 2").select(*key).withColumn("hash", F.lit(None).cast("string"))
    once = files.inherit(new, old)
    assert rows(once, "path", "hash") == [("/a", "new"), ("/b", None)]
    assert files.inherit(once.drop("inherited"), old).where("inherited").count() == 0


def test_text_functions(spark):
    guard = lambda v: one(spark, v, text.csv_cell)
    assert [guard(v) for v in ("=cmd", "+1", "-2+3", "@SUM(A1)", "\tx", "/tank/a,b.bin", "=a,b")] == ["'=cmd", "'+1", "'-2+3", "'@SUM(A1)", "'\tx", '"/tank/a,b.bin"', "\"'=a,b\""]
    df = spark.createDataFrame([(47 * 1048576, 1.0), (0, 1.0), (5, 0.0)], "b long, s double")
    assert [r[0] for r in df.select(text.speed(F.col("b"), F.col("s"))).collect()] == ["47.0 MiB/s", "—", "—"]
    assert one(spark, "it's", text.shell_quote) == "'it'\\''s'"
    assert one(spark, "a\nb'c", text.shell_label) == "a?b?c"
    assert one(spark, "a\tb\x1b", text.terminal) == "a\\tb\\u{1b}"
    assert one(spark, "zfs-2.2.1-1", lambda c: text.reflink_gate(c, F.lit(True))) == "safe"
    assert one(spark, "2.2.0", lambda c: text.reflink_gate(c, F.lit(True))) == "unsafe"
    assert one(spark, "2.1.9", lambda c: text.reflink_gate(c, F.lit(True))) == "unsupported"
    assert one(spark, "nvme0n1p2", text.base_device) == "nvme0n1" and one(spark, "sda1", text.base_device) == "sda"
    assert one(spark, "/path/longer", lambda c: text.truncate_left(c, 5)) == "…nger"
    assert one(spark, " ..JPG ", paths.normal_extension) == "jpg" and one(spark, "/a/.bashrc", paths.extension) == ""
    assert one(spark, "2024-01-01 00:00:00", lambda c: text.age(c, F.lit("2024-01-01 02:00:00").cast("timestamp"))) == "2 h ago"


def test_retention(spark):
    scans = spark.createDataFrame([(i, "complete" if i != 3 else "aborted", ["/r"], False) for i in range(1, 6)], "id long, status string, roots array<string>, trashed boolean")
    assert rows(sessions.retention(scans, 2), "id", "to_trash") == [(1, True), (2, True), (3, True), (4, False), (5, False)]


def test_numbered_names_skip_taken(spark):
    moved = spark.createDataFrame([("/s/a.txt", "a.txt", 1, "h"), ("/t/a.txt", "a.txt", 1, "h"), ("/s/b", "b", 2, "q")], "path string, name string, size long, hash string")
    there = spark.createDataFrame([("z", 1, "h"), ("a.dup1.txt", 9, "x"), ("b", 3, "y")], "name string, size long, hash string")
    assert rows(panels.move_decisions(moved, there), "path", "new_name") == [("/s/a.txt", "a.dup2.txt"), ("/s/b", "b.1"), ("/t/a.txt", "a.dup3.txt")]


def test_walk_store_and_hash(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "d").mkdir(parents=True)
    (root / "a").write_text("same")
    (root / "d" / "b").write_text("same")
    os.symlink(root / "a", root / "link")
    spark.dataSource.register(Walk)
    m = spark.read.format("walk").option("roots", str(root)).load()
    done = hashed(m)
    assert done.count() == 2 and done.select("hash").distinct().count() == 1 and done.where("error is not null").count() == 0
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.read("file").count() == 0
    store.record_files(m, 1)
    store.record_files(m, 2)
    store.record_files(m.limit(1), 1)
    assert {r["scan_id"]: r["count"] for r in store.read("file").groupBy("scan_id").count().collect()} == {1: 1, 2: 2}


def test_places_without_a_task_that_sees_all_rows(spark):
    rows = [(i, "hot" if i % 3 else str(i % 7), f"/d{i * 37 % 11}/{i * 7919 % 6007:05d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, k string, path string")
    order = sorted(rows, key=lambda r: r[2].split("/"))
    whole = ranks.by_order(df, F.split("path", "/"), "n")
    assert {r.id: r.n for r in whole.collect()} == {r[0]: n for n, r in enumerate(order, 1)}
    want, seen = {}, {}
    for i, k, _ in sorted(rows, key=lambda r: r[2]):
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert {r.id: r.n for r in ranks.within(df, ["k"], "path", "n").collect()} == want
    assert ranks.by_order(df.limit(0), F.col("path"), "n").isEmpty() and ranks.within(df.limit(0), ["k"], "path", "n").isEmpty()
