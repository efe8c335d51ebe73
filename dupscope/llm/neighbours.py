"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own centroids (k-means on a
bounded sample); a vector's cell is its pair of centroids.  A query walks pairs of centroids
in the order of summed squared distance with a heap over the two sorted lists, until the cells
walked hold enough vectors, and those entries are reranked by exact Euclidean distance in
double precision, ties to the smaller id.  How many are enough is measured: for a fixed number of
sampled vectors the true neighbours are found by one scan, and the walk is made as long as it
takes to meet a share of ``RECALL`` of them.  Well clustered vectors need short walks; on noise
in many dimensions the walk must grow with the index, whatever the method.

Equal vectors are one entry with its ``k + 1`` smallest ids: more copies can't be in any answer,
so a large group of copies is never met pair by pair, and nothing is lost.  Equal queries are
answered once.  The entries of a centroid of the first half are cut into blocks, so a task holds
one block and the queries that walk there.  A walk ends only with k + 1 entries or all cells, so
an answer has k rows wherever there are k candidates.

Vectors that are null or zero, have null or non-finite parts, or another dimension than most of the sample
take no part.  Repeated ids are separate candidates under one id; a query never returns its own id.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sampling, scratch
from .ngram_jaccard import sorted_groups

#: Vectors of the sample that centroids are fitted on; centroids of each half, at least and at most: with four times as many
#: vectors than FEW there are twice as many, so that cells keep their size.
SAMPLE, CENTROIDS, MOST, FEW = 16_000, 64, 512, 50_000
#: Sampled vectors that the length of the walk is set by, and the share of their true neighbours it must meet.
CALIBRATED, RECALL = 64, 0.95
#: Entries in one block of a first-half centroid.
BLOCK = 4096


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """id, v of the vectors that take part."""
    ok = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null").where(ok)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (((c**2).sum(1)[None] - 2 * x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, column, len(c)) for column in x.T], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _halves(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    at = x.shape[1] // 2
    return [(h**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * h @ c.T for h, c in zip((x[:, :at], x[:, at:]), books)]


def walk(da: np.ndarray, db: np.ndarray, held: dict[int, int], want: int, width: int) -> list[int]:
    """Cells by summed distance until they hold `want` entries."""
    a, b = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    heap, seen, got, total = [(da[a[0]] + db[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and total < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * width + int(b[j])
        if cell in held:
            got.append(cell)
            total += held[cell]
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (da[a[p]] + db[b[q]], p, q))
    return got


def _nearest(v: np.ndarray, ids: np.ndarray, q: np.ndarray, ok: np.ndarray | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places in v, distances) of the k nearest of v that ok allows, exact, ties to the smaller id."""
    square = (v**2).sum(1)
    for lo in range(0, len(q), 128):
        d = square[None] - 2 * q[lo : lo + 128] @ v.T
        if ok is not None:
            d[~ok[lo : lo + 128]] = np.inf
        for r in range(len(d)):
            own = d[r]
            if k < len(own):  # all that may be among the k after rounding
                edge = np.partition(own, k - 1)[k - 1]
                at = np.flatnonzero(own <= edge + 1e-9 * (1 + abs(edge) + square.max())) if np.isfinite(edge) else np.flatnonzero(np.isfinite(own))
            else:
                at = np.flatnonzero(np.isfinite(own))
            exact = np.sqrt(((v[at] - q[lo + r]) ** 2).sum(1))
            best = np.lexsort((ids[at], exact))[:k]
            yield lo + r, at[best], exact[best]


def calibrated(index: DataFrame, taken: np.ndarray, held: dict[int, int], books, k: int, recall: float) -> int:
    """Entries to walk so that of the true neighbours of CALIBRATED sampled vectors a share of `recall` is met.

    The truth is a brute-force scan of the whole index for these few vectors, in one pass.
    """
    dim, width = taken.shape[1], len(books[1])
    probes = taken[:CALIBRATED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
                rows = [(np.full(len(at), i), ids[at], d, batch.column(2).to_numpy()[at]) for i, at, d in _nearest(v, ids, probes, None, k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["ask", "id", "d", "cell"])

    top = index.mapInArrow(run, "ask long, id long, d double, cell long").withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy("d", "id")))
    truth: dict[int, list[int]] = {}
    for r in top.where((F.col("n") <= k + 1) & (F.col("d") > 0)).select("ask", "cell").collect():  # CALIBRATED * (k + 1) rows at most
        truth.setdefault(r["ask"], []).append(r["cell"])
    reach = []
    for i, (da, db) in enumerate(zip(*_halves(probes, books))):
        order = walk(da, db, held, 1 << 62, width)
        total = dict(zip(order, np.cumsum([held[c] for c in order]).tolist()))
        reach += [total[c] for c in truth.get(i, [])]
    return int(np.quantile(reach, recall)) if reach else 1


def grown(n: int) -> int:
    """Centroids of each half for an index of n vectors."""
    return min(MOST, CENTROIDS << max(0, (n // FEW).bit_length() - 1) // 2)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, centroids: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """vectors, queries: id, v (from :func:`usable`) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    taken = sampling.first_by_hash(vectors, F.xxhash64("id"), sample, "id").select("v").toArrow()["v"].to_pylist()
    if not taken:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = Counter(map(len, taken)).most_common(1)[0][0]
    x = np.array([v for v in taken if len(v) == dim])
    if centroids is None:
        centroids = grown(vectors.count())
    books = (kmeans(x[:, : dim // 2], centroids), kmeans(x[:, dim // 2 :], centroids)) if dim > 1 else (np.zeros((1, 0)), kmeans(x, centroids))
    width = len(books[1])

    same = Window.partitionBy("v").orderBy("id")
    numbered = vectors.where(F.size("v") == dim).withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (d.argmin(1) for d in _halves(_matrix(batch.column(1), dim), books))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((one * width + two).astype(np.int64))], ["id", "v", "cell"])

    index = scratch.cut(numbered.mapInArrow(assign, "id long, v array<double>, cell long"), "index")
    held = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST ** 2 rows at most
    entries = calibrated(index, x, held, books, k, recall)

    asked = queries.where(F.size("v") == dim)
    one_each = scratch.cut(asked.groupBy("v").agg(F.min("id").alias("ask")), "asked")
    rows = Counter()
    for cell, n in held.items():
        rows[cell // width] += n
    blocks = spark.createDataFrame([(c, -(-n // BLOCK)) for c, n in rows.items()], "half long, blocks long")  # a row for each centroid

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, list[int]]] = []
            for r, (da, db) in enumerate(zip(*_halves(_matrix(batch.column(0), dim), books)) if batch.num_rows else ()):
                halves: dict[int, list[int]] = {}
                for cell in walk(da, db, held, max(entries, k + 1), width):
                    halves.setdefault(cell // width, []).append(cell % width)
                out += [(r, half, other) for half, other in halves.items()]
            if out:
                at, half, other = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), batch.column(0).take(pa.array(at)), pa.array(half, pa.int64()), pa.array(other, pa.list_(pa.int32()))], ["id", "v", "half", "others"])

    routed = one_each.select("v", "ask").mapInArrow(route, "id long, v array<double>, half long, others array<int>")
    entry = index.withColumn("half", F.floor(F.col("cell") / width)).join(F.broadcast(blocks), "half").select("half", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(0).alias("kind"), "id", "v", F.array((F.col("cell") % width).cast("int")).alias("others"))
    probe = routed.join(F.broadcast(blocks), "half").select("half", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v", "others")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in sorted_groups(batches, ("half", "block")):
            for p, q in zip(at[:-1], at[1:]):
                group = table.slice(p, q - p)
                kind, ids, v = group.column("kind").to_numpy(), group.column("id").to_numpy(), _matrix(group.column("v"), dim)
                m = int(np.searchsorted(kind, 1))
                if not 0 < m < len(kind):
                    continue
                others = group.column("others").to_pylist()
                wanted = np.zeros((len(kind) - m, width), bool)
                for r, own in enumerate(others[m:]):
                    wanted[r, own] = True
                ok = wanted[:, [o[0] for o in others[:m]]]
                out = [(np.full(len(place), ids[m + r]), ids[place], d) for r, place, d in _nearest(v[:m], ids[:m], v[m:], ok, k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["ask", "vec_id", "score"])

    keys = ["half", "block"]
    found = entry.union(probe).repartition(scratch.partitions(spark), *keys).sortWithinPartitions(*keys, "kind").mapInArrow(rerank, "ask long, vec_id long, score double")
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("ask").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    # Equal queries share their class's list; each then leaves itself out.
    named = asked.join(one_each, "v").select(F.col("id").alias("query_id"), "ask").distinct()
    every = named.join(top, "ask").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
