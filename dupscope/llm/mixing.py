"""Mixing sources to target weights, with repeats, by balanced sampling.

Targets: the sizes of all documents together are shared among the sources by weight; a target
stops at ``most`` times its source's size and the excess is reshared by weight until none is
above.  A source's documents are then all taken ``floor(target / size)`` times, and once more
with the fractional part as inclusion probability.

Method: the cube.  The fractional probabilities move through the null space of two constraints
(number of documents, tokens) until they are 0 or 1: of three undecided documents a direction
that changes neither total is followed as far as it goes, either way, at odds that keep every
probability.  The flight runs in blocks of one source; each block leaves at most three undecided,
which form the blocks of the next level, until one block of each source is left.  Its last few
documents are landed on the combination whose tokens are nearest.  Odds come from hashes of
doc_id and seed, so reruns agree.

Null text: size 0 and never more than 0 words.  Null source: a source of its own, last in order.
Repeated rows are separate units.  Sources are the dimension the weights are given for, so only
per-source totals (one row each) are handled together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranks
from . import scratch, words
from .ngram_jaccard import sorted_groups

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents that a landing may change besides the last three.
SWAPS = 8
#: Documents of one flight.
BLOCK = 2048
#: Equal rows that are numbered in one task.
COPIES = 1 << 14


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.word_counts(batch.column(2)))], ["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(run, "doc_id long, source string, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, sid (place by code point, null last), source_size, docs, target: a level that no source's cap is below."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    w = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    t = totals.withColumn("sid", F.row_number().over(w) - 1).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("capped_before", F.sum("cap").over(up) - F.col("cap")).withColumn("weight_left", F.sum("weight").over(Window.partitionBy()) - F.sum("weight").over(up) + F.col("weight"))
    t = t.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.col("capped_before")) / F.col("weight_left"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy())
    return t.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))).select("source", "sid", "source_size", "docs", "target")


def _odds(ids: np.ndarray, seed: int) -> np.ndarray:
    return (words.mix(ids.astype(np.int64).view(np.uint64), 1000 + seed) >> words.U(11)).astype(np.float64) / (1 << 53)


def flight(p: np.ndarray, size: np.ndarray, odds: np.ndarray, land: bool) -> np.ndarray:
    """Probabilities moved to 0 or 1; at most three stay between (none if land)."""
    sure = (p < 1e-9) | (p > 1 - 1e-9)
    p, scale = p.astype(np.float64).tolist(), max(float(size.max(initial=0)), 1.0)
    x = (size / scale).tolist()
    eps = 1e-9
    active: list[int] = []
    for k in range(len(p)):
        if not eps < p[k] < 1 - eps:
            p[k] = round(p[k])
            continue
        active.append(k)
        while len(active) > 2:
            a, b, c = active[:3]
            u = [x[c] - x[b], x[a] - x[c], x[b] - x[a]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            now = (a, b, c)
            up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(now, u) if d)
            down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(now, u) if d)
            step = up if odds[k] * (up + down) < down else -down
            for i, d in zip(now, u):
                p[i] += step * d
            stay = [i for i in now if eps < p[i] < 1 - eps]
            for i in now:
                if i not in stay:
                    p[i] = round(p[i])
            if len(stay) == 3:
                break
            active = stay
    if land and active:
        want, many = sum(p[i] * x[i] for i in active), sum(p[i] for i in active)
        best = min(range(1 << len(active)), key=lambda m: (abs(sum(x[i] for j, i in enumerate(active) if m >> j & 1) - want), abs(bin(m).count("1") - many), m))
        for j, i in enumerate(active):
            p[i] = best >> j & 1
        off = sum(p[i] * x[i] for i in active) - want
        for _ in range(SWAPS):  # a giant among the last ones: settle its rest with documents of about that size
            i = min(range(len(p)), key=lambda i: np.inf if sure[i] else abs(off + (1 - 2 * p[i]) * x[i]))
            if sure[i] or abs(off + (1 - 2 * p[i]) * x[i]) >= abs(off):
                break
            off += (1 - 2 * p[i]) * x[i]
            p[i] = 1 - p[i]
    return np.array(p, np.float64)


def choose(units: DataFrame, seed: int = 0) -> DataFrame:
    """units: sid, doc_id, size, p, ... -> the same rows with p 0 or 1."""
    schema = units.schema
    done, level = None, 0
    while True:
        counts = units.groupBy("sid").agg(F.count(F.lit(1)).alias("units"))
        blocks = scratch.cut(counts.select("sid", F.ceil(F.col("units") / BLOCK).alias("blocks")), "blocks")
        last = (blocks.agg(F.max("blocks")).first()[0] or 1) == 1
        dealt = units.join(blocks, "sid").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), F.col("blocks"))).withColumn("alone", F.col("blocks") == 1).drop("blocks")

        def run(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for table, at in sorted_groups(batches, ("sid", "block")):
                p, size, alone = (table.column(c).to_numpy() for c in ("p", "size", "alone"))
                odds = _odds(table.column("doc_id").fill_null(-1).to_numpy(), seed + level)
                new = [flight(p[i:j], size[i:j], odds[i:j], bool(alone[i])) for i, j in zip(at[:-1], at[1:])]
                table = table.set_column(table.column_names.index("p"), "p", pa.array(np.concatenate(new)))
                yield from table.select(schema.names).to_batches()

        moved = dealt.repartition(scratch.partitions(units.sparkSession), "sid", "block").sortWithinPartitions("sid", "block", F.desc("size"), "doc_id", "key").mapInArrow(run, schema)
        moved = scratch.cut(moved, "flight")
        if last:
            return moved if done is None else done.unionByName(moved)
        decided = moved.where("p = 0 or p = 1")
        done = decided if done is None else done.unionByName(decided)
        units, level = moved.where("p <> 0 and p <> 1"), level + 1


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """sized (doc_id, source, size, key: any long that tells rows of one doc_id apart) -> those, source_size, target, times, taken."""
    goal = scratch.cut(targets(sized, weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = sized.withColumnRenamed("source", "own")
    units = named.join(goal, F.col("own").eqNullSafe(F.col("source"))).select("sid", "doc_id", "key", "source", "size", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"))
    chosen = choose(units, seed)
    times = (F.col("whole") + F.col("p").cast("long")).cast("int")
    return chosen.select("doc_id", "key", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken of every document."""
    return mix(scratch.cut(sizes(docs).withColumn("key", F.lit(0).cast("long")), "sizes"), weights, most, seed).drop("key")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The mix itself: each document as many times as it is taken.  Rows of one doc_id are told apart by all their columns."""
    told = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    keyed = docs.withColumns({"key_": told, "id_": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words.word_counts(batch.column(3)))], ["doc_id", "source", "key", "size"])

    sized = scratch.cut(keyed.select(F.col("doc_id").cast("long"), "source", "key_", "text").mapInArrow(run, "doc_id long, source string, key long, size long"), "sizes")
    units = mix(sized, weights, most, seed).groupBy(F.coalesce("doc_id", F.lit(0)).alias("id_"), F.col("key").alias("key_"))
    taken = scratch.cut(units.agg(F.sum("times").alias("sum_"), F.count(F.lit(1)).alias("rows_")).where("sum_ > 0"), "times")
    out = keyed.join(taken, ["id_", "key_"])
    times = out.where("rows_ = 1").withColumn("times_", F.col("sum_").cast("int")).drop("sum_", "rows_")
    if not taken.where("rows_ > 1").isEmpty():  # equal rows share the sum of their times, the first ones one more than the others
        many = out.where("rows_ > 1").withColumn("tie_", F.monotonically_increasing_id())
        share = F.expr("cast(sum_ div rows_ + if(row_ <= sum_ % rows_, 1, 0) as int)")
        times = times.union(ranks.within(many, ["id_", "key_"], "tie_", "row_", COPIES).withColumn("times_", share).select(*times.columns))
    out = times.where("times_ > 0")
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_")))).select(*docs.columns)
