"""Connected components: links contracted inside partitions, then alternating large-star and small-star steps between them.

Partitions are as many as the links need at PER_TASK each, whatever the session's number of shuffle partitions, so few links cost few
tasks.  Inside a partition links become stars around the smallest node of each local component, in memory bounded by PER_TASK.  One partition is
then done; between several, steps (joins and minima) hang nodes on smaller ones until all is stars, which takes a number of steps that grows with the logarithm
of the nodes.  Hubs are joined, never gathered: a hub's links stay rows that a skewed join may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

#: Links contracted in one task.
PER_TASK = 1 << 21


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): every node of the links, with the smallest node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[one], up[two]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        one, two = one[apart], two[apart]
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up, up[up]):
            up = up[up]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """edges (a, b) as stars (a, b), b the smallest node of a's component within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, stars = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def taken() -> tuple[np.ndarray, np.ndarray]:
            nodes, root = roots(*(np.concatenate([s, *(h[i] for h in held)]) for i, s in enumerate(stars)))
            own = nodes != root
            return nodes[own], root[own]

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > PER_TASK // 4:
                stars, held, n = taken(), [], 0
        a, b = taken()
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])

    return edges.coalesce(parts).mapInArrow(words.tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, component), component the smallest node reachable.  Nodes without a link don't appear."""
    raw = scratch.cut(edges.select("a", "b").where("a <> b"), "links")
    parts = -(-raw.count() // PER_TASK)
    now = scratch.cut(_contracted(raw, max(1, parts)), "stars")
    scratch.drop(raw)
    while parts > 1:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").union(lower.select("a", "m"))
        after = scratch.cut(_contracted(small, parts), "stars")
        scratch.drop(now)
        now = after
        parts = -(-now.count() // PER_TASK)
        twice = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if parts <= 1:  # what is left fits one task
            after = scratch.cut(_contracted(now, 1), "stars")
            scratch.drop(now)
            now = after
        elif twice.isEmpty() and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break  # each node hangs on one that hangs on none
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.select("node", F.col("node").alias("component")))
