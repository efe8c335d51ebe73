"""Bounded samples, and keys that many rows share."""

import collections

import pytest
from pyspark.sql import functions as F

from dupscope.llm import mixing, packing, sampling


@pytest.mark.parametrize("ids", [range(5000), [7] * 4000 + list(range(100)), range(30), []])
def test_samples_are_the_rows_of_smallest_hash(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = [r.id for r in sampling.first_by_hash(rows, F.xxhash64("id"), 50, "id").collect()]
    assert got == [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(50).collect()]


def test_copies_of_one_row_are_numbered_in_many_tasks(spark, monkeypatch):
    rows = [(1, "a b c", "s0")] * 900 + [(2, "a b", "s1")] * 300 + [(None, None, "s1")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = collections.Counter(map(tuple, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "COPIES", 50)
    assert collections.Counter(map(tuple, mixing.mixed(docs).collect())) == want and sum(want.values()) > 500


def test_pieces_of_one_id_are_ranked_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    items = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(30).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"), F.col("id").alias("row_"))
    placed = packing.place(items, 100)
    spots = collections.Counter((r.sequence_id, r.offset) for r in placed.collect())
    assert len(spots) == 400 and len({s for s, _ in spots}) == 134
    assert placed._jdf.queryExecution().toString().count("row_") > 0
