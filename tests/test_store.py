"""The store's tables, ranks without a single task, and cases that went wrong before."""

import random

import pytest
from pyspark.sql import functions as F

from dupscope.operators import dirs, panels, plan, ranks, sessions
from dupscope.sources import config
from dupscope.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def file_rows(spark, paths):
    return spark.createDataFrame([(p, 1, 2, 0, 0, 0, 1, 1, 1) for p in paths], "path string, size long, mtime long, mtime_nsec long, ctime_sec long, ctime_nsec long, identity_version int, device long, inode long")


def scan_rows(spark, *ids, trashed=False):
    return spark.createDataFrame([(i, "c", "u", "complete", "{}", trashed) for i in ids], "id long, created_at string, updated_at string, status string, config_json string, trashed boolean")


def test_an_empty_walk_replaces_the_old_manifest(spark, store):
    store.record_files(file_rows(spark, ["/a", "/b"]), 1)
    store.record_files(file_rows(spark, ["/a"]), 2)
    store.record_files(file_rows(spark, []), 1)
    assert [(r.scan_id, r.path) for r in store.read("file").collect()] == [(2, "/a")]
    store.clear("file", 2)
    assert store.read("file").count() == 0


def test_scans_are_replaced_one_by_one_and_purged(spark, store):
    store.replace("scan", scan_rows(spark, 1, 3))
    store.replace("scan", scan_rows(spark, 2, trashed=True))
    store.record_files(file_rows(spark, ["/a", "/b"]), 2)
    store.record_files(file_rows(spark, ["/c"]), 3)
    assert sorted(r.id for r in store.read("scan").collect()) == [1, 2, 3]
    ids, before, after = sessions.compacted(store)
    assert ids == [2] and before >= after == 3
    assert sorted(r.id for r in store.read("scan").collect()) == [1, 3] and [r.path for r in store.read("file").collect()] == ["/c"]


def test_both_algorithms_give_the_same_twins_at_any_depth(spark):
    rows = [("/a/f", "X"), ("/b/f", "X"), ("/a/s/t/u/g", "Y"), ("/b/s/t/u/g", "Z"), ("/c/f", "X"), ("/c/s/t/u/g", "Y"), ("/d/f", "X"), ("/d/s/g", None)]
    m = spark.createDataFrame([(p, 1, h) for p, h in rows], "path string, size long, hash string")
    twins = lambda s: sorted(tuple(r.paths) for r in dirs.groups(s).collect())
    assert twins(dirs.merkle(m)) == twins(dirs.signatures(m)) and ("/a", "/c") in twins(dirs.merkle(m)) and dirs.merkle(m.limit(0)).count() == 0


@pytest.mark.parametrize("values", [lambda r, i: 7, lambda r, i: r.randrange(5), lambda r, i: r.randrange(10**12), lambda r, i: 1 if i % 3 else r.randrange(100)])
def test_ranks(spark, values):
    rng = random.Random(2)
    rows = [(values(rng, i), f"{rng.getrandbits(256):064x}") for i in range(700)]
    out = ranks.by_benefit(spark.createDataFrame(rows, "v long, h string"), "v", "h", 1)
    want = {x: k for k, x in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1)}
    assert {(r.v, r.h): r["rank"] for r in out.collect()} == want


def test_ranks_of_no_rows(spark):
    assert ranks.by_benefit(spark.createDataFrame([], "v long, h string"), "v", "h", 0).count() == 0


def test_numbered_names_need_no_cartesian_product(spark):
    there = spark.createDataFrame([("a.txt",), ("a.dup1.txt",), ("a.dup3.txt",), ("b",), ("b.1",), ("a.dup7",)], "name string")
    rows = spark.createDataFrame([("/x/a.txt", "a.txt", "duplicate"), ("/y/a.txt", "a.txt", "duplicate"), ("/x/b", "b", "renamed"), ("/x/c", "c", "moved")], "path string, name string, decision string")
    out = panels.numbered_names(rows, there)
    assert {r.path: r.new_name for r in out.collect()} == {"/x/a.txt": "a.dup2.txt", "/y/a.txt": "a.dup4.txt", "/x/b": "b.2", "/x/c": "c"}
    explained = out._jdf.queryExecution().toString()
    assert "Cartesian" not in explained and "NestedLoop" not in explained


def test_configuration(spark):
    rows = spark.createDataFrame([(1, '{"roots": ["/a"], "min_size": 1}'), (2, "{broken"), (3, '{"roots": ["/b"], "dir_sig_algo": "merkle", "include_extensions": ["md"], "reuse_hashes": true, "hash_profile": "Turbo"}')], "id int, json string")
    out = {r.id: r.c for r in rows.select("id", config.decoded(F.col("json")).alias("c")).collect()}
    assert out[2] is None and (out[1].reuse_hashes, out[1].hash_profile, out[1].dir_sig_algo, out[1].include_extensions) == (False, "Balanced", "old", [])
    assert (out[3].dir_sig_algo, out[3].include_extensions, out[3].reuse_hashes, out[3].hash_profile) == ("merkle", ["md"], True, "Turbo")
    again = rows.where("id <> 2").select(config.decoded(F.col("json")).alias("c")).select(config.decoded(config.encoded(F.col("c"))).eqNullSafe(F.col("c")).alias("same"))
    assert all(r.same for r in again.collect())
    broken = config.presets(spark, spark.createDataFrame([("[{",)], "value string"))
    assert [r.name for r in broken.orderBy("place").collect()] == ["All", "Images", "Office documents"]


def test_statistics_of_a_new_scan(spark):
    stats = spark.createDataFrame([(1, 2.0, 5)], "scan_id long, elapsed_seconds double, files_scanned long")
    out = sessions.updated(stats, spark.createDataFrame([(1, 1.5), (9, 3.0)], "scan_id long, elapsed_seconds double"))
    assert sorted(map(tuple, out.collect())) == [(1, 3.5, 5), (9, 3.0, 0)]


def test_plan_from_groups_skips_the_same_physical_file(spark):
    rows = [("A", 0, "/a", 1, 1, 1, True, None), ("A", 1, "/b", 1, 1, 1, False, "delete"), ("A", 2, "/c", 1, 1, 2, False, "hardlink"), ("A", 3, "/d", 1, 1, 3, False, None), ("B", 0, "/e", 1, 1, 4, False, "delete"), ("A", 4, "/f", 1, 1, 5, False, "melt")]
    files = spark.createDataFrame(rows, "hash string, place int, path string, size long, device long, inode long, is_keeper boolean, action string")
    assert [(r.kind, r.target, r.keeper) for r in plan.from_groups(files).collect()] == [("hardlink", "/c", "/a")]


def test_walk_of_odd_roots(spark, tmp_path):
    import json
    import os

    from dupscope.sources.walker import Walk

    spark.dataSource.register(Walk)
    base = tmp_path / "a:b"
    (base / "d" / "e").mkdir(parents=True)
    (base / "d" / "e" / "f").write_text("x")
    (tmp_path / "one").write_text("yy")
    os.symlink(base, base / "d" / "loop")
    read = lambda roots, follow="false": sorted(r.path for r in spark.read.format("walk").option("roots", json.dumps([str(r) for r in roots])).option("followSymlinks", follow).load().collect())
    assert read([base, tmp_path / "one"]) == sorted([f"{base}/d/e/f", f"{tmp_path}/one"])
    assert f"{base}/d/e/f" in read([base], "true")
