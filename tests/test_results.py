"""Stored results of scans, the journal, and the order of reading."""

from pyspark.sql import functions as F

from dupscope.operators import dirs, files, groups, sessions
from dupscope.sources.schema import FILE
from dupscope.sources.store import Store


def manifest(spark, scan, rows):
    return spark.createDataFrame([(scan, p, len(h or p), 1, 0, 0, 0, 1, i % 3, 100 - i, h) for i, (p, h) in enumerate(rows)], FILE)


def test_results_are_stored_and_replaced(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = [("/a/x", "h1"), ("/b/x", "h1"), ("/c/y", "h2"), ("/c/z", None), ("/d/z", None)]
    store.append("file", manifest(spark, 1, one))
    store.append("file", manifest(spark, 2, [("/q/x", "h1")]))
    begun = sessions.begun(spark.createDataFrame([(0, "c")], "id long, created_at string"), "{}", "now")
    store.append("scan_stats", sessions.begun_statistics(begun, store.read("scan_stats")))
    assert [(r.scan_id, r.files_scanned, r.results_materialized) for r in store.read("scan_stats").collect()] == [(1, 0, False)]
    for algorithm in ("old", "merkle"):
        sessions.materialized(store, 1, algorithm)
        sessions.materialized(store, 2, algorithm)
        assert [(r.scan_id, r["rank"], r.hash, r.file_count, r.size, r.reclaim) for r in store.read("file_group").collect()] == [(1, 0, "h1", 2, 2, 2)]
        assert sorted((r.scan_id, r.path, r.file_count, r.size_per_dir) for r in store.read("dir_dedup").collect()) == [(1, "/a", 1, 2), (1, "/b", 1, 2)]
        stats = {r.scan_id: (r.groups_found, r.reclaimable_bytes, r.hash_failures, r.results_materialized) for r in store.read("scan_stats").collect()}
        assert stats == {1: (1, 2, 2, True), 2: (0, 0, 0, True)}
    store.replace("file", manifest(spark, 1, one[2:3]), 1)
    sessions.materialized(store, 1)
    assert store.read("file_group").isEmpty() and store.read("dir_dedup").isEmpty()


def test_the_journal_goes_on(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    moves = spark.createDataFrame([("t", 1, f"/s/{i}", f"/t/{i}", None, False) for i in range(5)], "created_at string, scan_id long, source_path string, target_path string, hash string, duplicate boolean")
    sessions.record_moves(store, moves)
    sessions.record_moves(store, moves.limit(2))
    assert sorted((r.id, r.source_path) for r in store.read("move_event").collect()) == [*((i + 1, f"/s/{i}") for i in range(5)), (6, "/s/0"), (7, "/s/1")]


def test_files_are_read_in_the_order_of_their_places(spark):
    rows = [(i % 3, i * 7919 % 1009) for i in range(600)]
    out = files.read_order(spark.createDataFrame(rows, "device long, inode long"), 4).withColumn("part", F.spark_partition_id()).collect()
    parts = {}
    for r in out:
        parts.setdefault(r.part, []).append((r.device, r.inode))
    assert all(p == sorted(p) for p in parts.values()) and len(parts) > 1
    assert sum((parts[k] for k in sorted(parts)), []) == sorted(rows)


def test_lookups(spark):
    m = spark.createDataFrame([("/a/x", 1, "h"), ("/b/x", 1, "h"), ("/c/x", 1, "k")], "path string, size long, hash string")
    asked = spark.createDataFrame([("h",), ("zz",), ("h",)], "hash string")
    assert sorted(map(tuple, groups.member_counts(m, asked).collect())) == [("h", 2), ("zz", 0)]
    signed = dirs.signatures(m, only_twins=False)
    own = {r["dir"]: r.signature for r in signed.collect()}
    found = dirs.paths_of(signed, spark.createDataFrame([(own["/a"],)], "signature string")).collect()
    assert [r["dir"] for r in found] == ["/a", "/b"]
