"""Commits of the store under kills, replays and other writers; streams against the same rows at once."""

import pytest
from pyspark.sql import functions as F

from dupscope.operators import files
from dupscope.sources.store import Conflict, Store
from dupscope.streaming import incremental, progress


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(spark, *paths, scan=1):
    return spark.createDataFrame([(scan, p, 1, 2, 0, 0, 0, 1, 1, 1, None) for p in paths], "scan_id long, path string, size long, mtime long, mtime_nsec long, ctime_sec long, ctime_nsec long, identity_version int, device long, inode long, hash string")


def held(store, version=None):
    return sorted((r.scan_id, r.path) for r in store.read("file", version).collect())


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["_written", "_publish", "vacuum"])
@pytest.mark.parametrize("work", ["replace", "append", "compact", "clear", "purge"])
def test_a_kill_leaves_the_old_or_the_new_table(spark, store, tmp_path, monkeypatch, step, work):
    store.append("file", rows(spark, "/a"))
    store.append("file", rows(spark, "/b"))
    store.append("file", rows(spark, "/c", scan=2))
    before = held(store)
    after = {"replace": [(1, "/d"), (2, "/c")], "append": before + [(2, "/d")], "compact": before, "clear": [(2, "/c")], "purge": [(2, "/c")]}[work]
    do = {
        "replace": lambda: store.replace("file", rows(spark, "/d")),
        "append": lambda: store.append("file", rows(spark, "/d", scan=2)),
        "compact": lambda: store.compact("file"),
        "clear": lambda: store.clear("file", 1),
        "purge": lambda: store.purge([1]),
    }[work]
    own = getattr(Store, step)

    def dies(self, *a):
        if step == "_written":  # after the data, before the commit
            own(self, *a)
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(Store, step, dies)
        try:
            do()
        except Killed:
            pass
    assert held(store) in (before, sorted(after))
    if step == "_publish":
        assert held(store) == before
    do()  # a second run works on what the kill left
    if work != "append" or step != "vacuum":
        assert held(store) == sorted(after)
    (tmp_path / "store" / "file" / "log" / ".new-left").write_text("{")
    store.vacuum("file")
    assert held(store) in (sorted(after), sorted(after + [(2, "/d")])) and len(store._names(f"{store.path('file')}/log")) == 1


def test_two_writers_both_stay(spark, store, monkeypatch):
    other, own = Store(spark, store.root), Store._publish
    first = []

    def late(self, text, path):
        if not first:
            first.append(1)
            other.append("file", rows(spark, "/other"))
        return own(self, text, path)

    monkeypatch.setattr(Store, "_publish", late)
    store.append("file", rows(spark, "/own"))
    assert held(store) == [(1, "/other"), (1, "/own")] and store.version("file") == 2
    assert held(store, 1) == [(1, "/other")]


def test_compaction_beside_other_writers(spark, store, monkeypatch):
    store.append("file", rows(spark, *[f"/{i}" for i in range(40)]))
    store.append("file", rows(spark, "/x"))
    own = Store._written
    for what, want in ((lambda: Store(spark, store.root).append("file", rows(spark, "/y")), None), (lambda: Store(spark, store.root).clear("file", 1), Conflict)):
        def busy(self, name, df, most=0, what=what):
            made = own(self, name, df, most)
            monkeypatch.setattr(Store, "_written", own)
            what()
            return made

        monkeypatch.setattr(Store, "_written", busy)
        if want:
            with pytest.raises(want):
                store.compact("file")
            assert held(store) == []
        else:
            store.compact("file", rows=10)
            assert len(held(store)) == 42 and len(store.read("file").inputFiles()) >= 4


def test_a_replayed_batch_is_added_once(spark, store):
    a, b = rows(spark, "/a", "/b"), rows(spark, "/c")
    assert incremental.added(store, a, "s", 0) and not incremental.added(store, a, "s", 0)
    assert incremental.added(store, b, "s", 1) and not incremental.added(store, a, "s", 0)
    assert incremental.added(store, rows(spark, "/z", scan=2), "other", 0)
    assert held(store) == [(1, "/a"), (1, "/b"), (1, "/c"), (2, "/z")]


def test_a_stream_that_dies_before_its_checkpoint(spark, store, tmp_path, monkeypatch):
    """The batch is committed, the stream dies before Spark notes it, and comes again with the same number."""
    source, check = f"{tmp_path}/walked", f"file://{tmp_path}/check"
    old = rows(spark, "/a").withColumn("hash", F.lit("known")).withColumn("scan_id", F.lit(9).cast("long"))
    store.append("file", old)
    rows(spark, "/a", "/b").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(rows(spark).schema).parquet(source)
    own = incremental.added

    def dies(*a):
        own(*a)
        raise Killed

    monkeypatch.setattr(incremental, "added", dies)
    with pytest.raises(Exception, match="Killed"):
        incremental.scans(stream(), store, check).trigger(availableNow=True).start().awaitTermination()
    monkeypatch.setattr(incremental, "added", own)
    incremental.scans(stream(), store, check).trigger(availableNow=True).start().awaitTermination()
    rows(spark, "/c").coalesce(1).write.mode("append").parquet(source)
    incremental.scans(stream(), store, check).trigger(availableNow=True).start().awaitTermination()
    assert held(store) == [(1, "/a"), (1, "/b"), (1, "/c"), (9, "/a")]
    assert {r.path: r.hash for r in store.read("file").where("scan_id = 1").collect()} == {"/a": "known", "/b": None, "/c": None}


def test_rates_of_a_stream_are_those_of_the_rows_at_once(spark, tmp_path):
    made = [(k, 0.7 * i + k, i * i * 10, 9000) for i in range(30) for k in range(4) if (i + k) % 5]
    schema = "k long, t double, d long, total long"
    for n in range(3):
        spark.createDataFrame([r for r in made if n * 10 <= (r[1] - r[0]) / 0.7 + 1e-9 < n * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = progress.rates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "k", "t", "d", "total")
        stream.writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table("rates").collect()
    want = {str(r.k): (r.rate, r.eta) for r in files.progress(spark.createDataFrame(made, schema), "k", "t", "d", "total").collect()}
    assert len(got) == 12 and {r.series: (r.rate, r.eta) for r in got} == want
