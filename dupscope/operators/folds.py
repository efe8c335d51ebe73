"""Folds over the sorted rows of a key, in memory that doesn't grow with the rows of the key.

Rows are dealt by key and sorted within partitions (the sort spills to disk); a task reads them as Arrow batches and carries one
state from batch to batch.  Nothing is ever gathered into an array, so a key may have any number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dealt(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *order)


def _runs(column: pa.Array) -> Iterator[tuple[object, int, int]]:
    """(key, from, to) of the runs of equal keys of a sorted column."""
    if not len(column):
        return
    ends = pc.run_end_encode(column)
    start = 0
    for value, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
        yield value, start, end
        start = end


def digests(rows: DataFrame, key: str, order: list[str], entry: Column) -> DataFrame:
    """key, digest: sha-256 (lower-case hexadecimal) of the entries (text) of each key joined in order; null if one of them is null.

    entry is made of the columns in order, which alone are shuffled.  Consecutive entries lie side by side in a batch, so each run goes to the hash as
    one piece of memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, whole, begun = None, None, True, False
        for batch in batches:
            text = batch.column(1).cast(pa.large_string())
            _, at, data = text.buffers()
            offsets = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            held = memoryview(data) if data is not None else memoryview(b"")
            missing = np.asarray(text.is_null())
            keys, out = [], []
            for value, i, j in _runs(batch.column(0)):
                if not begun or value != now:
                    if begun:
                        keys.append(now)
                        out.append(state.hexdigest() if whole else None)
                    now, state, whole, begun = value, hashlib.sha256(), True, True
                whole = whole and not missing[i:j].any()
                if whole:
                    state.update(held[offsets[i] : offsets[j]])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], [key, "digest"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([state.hexdigest() if whole else None], pa.string())], [key, "digest"])

    named = rows.select(F.col(key).cast("string").alias(key), *order)
    return _dealt(named, key, order).select(key, entry.alias("entry_")).mapInArrow(run, f"`{key}` string, digest string")


#: Seconds between two rows up to which no rate is told; the shares of the old and the new rate in the smoothed one.
AT_ONCE, OLD, NEW = 0.5, 0.7, 0.3

Rate = tuple[float | None, float, float]


def smoothed(state: Rate | None, t: float, d: float) -> Rate:
    """(rate, time, bytes) after a row at time t with d bytes done: the first rate as it is, then 0.7 of the old and 0.3 of the new."""
    if state is None:
        return None, t, d
    rate, before, done = state
    now = 0.0 if t - before <= AT_ONCE else (d - done) / (t - before)
    return (now if rate is None else rate * OLD + now * NEW), t, d


def rates(rows: DataFrame, by: str, at: str, done: str, total: str) -> DataFrame:
    """by, ema, d, total: the smoothed rate at the end of each series of rows ordered by time, its last bytes and its largest total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, most, begun = None, None, None, False
        schema = None

        def row() -> list[pa.Array]:
            return [pa.array([now], schema), pa.array([state[0]], pa.float64()), pa.array([state[2]], pa.float64()), pa.array([most], pa.float64())]

        for batch in batches:
            schema = batch.schema.field(0).type
            t, d, all_ = (batch.column(i).to_pylist() for i in (1, 2, 3))
            made = []
            for value, i, j in _runs(batch.column(0)):
                if not begun or value != now:
                    if begun:
                        made.append(row())
                    now, state, most, begun = value, None, None, True
                for k in range(i, j):
                    state = smoothed(state, t[k], d[k])
                    most = all_[k] if most is None else most if all_[k] is None else max(most, all_[k])
            for arrays in made:
                yield pa.RecordBatch.from_arrays(arrays, ["k", "ema", "d", "total"])
        if begun:
            yield pa.RecordBatch.from_arrays(row(), ["k", "ema", "d", "total"])

    kind = rows.schema[by].dataType.simpleString()
    named = rows.select(F.col(by).alias("k"), F.col(at).cast("double").alias("t"), F.col(done).cast("double").alias("d"), F.col(total).cast("double").alias("total")).where("t is not null and d is not null")
    return _dealt(named, "k", ["t", "d"]).mapInArrow(run, f"k {kind}, ema double, d double, total double").withColumnRenamed("k", by)
