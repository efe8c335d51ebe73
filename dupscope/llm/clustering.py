"""Centroid clustering by sort-means, in exact integers.

Components become integers floor(256 c).  Each round the driver works out the distances between the few centroids and orders, for each
centroid, the others by their distance from it.  A vector starts at the centroid it had before (at number 0 in the first round) and
scans the others in that order; it stops at the first that lies strictly beyond twice its own distance, since by
the triangle inequality that one and all after it are farther than the one it has.  At exactly twice, another centroid may be as near and have
the smaller number, so it is still looked at.  All comparisons are between squared integers: d2(c, other) > 4 d2(x, c).

A round is one pass over the written table of vectors with their assignment, without a shuffle of vectors: a task writes
its rows with their new assignment and, at its end, a row for each centroid with counts and sums of its vectors.  Those rows alone
are grouped; new centroids are the exact floor(sum / count) of each component, and centroids without vectors stay.

The first centroids are the vectors of smallest sha256 of ``<seed>:<id>``; rows that share an id are told apart by their components.  Fewer vectors
than centroids: as many centroids as vectors.  Vectors take part if they have exactly the asked number of components, none null, NaN or
infinite, and none of 2**17 or more (four times a squared distance of such doesn't fit a long).  An inertia of over 2**63 - 1 is null.  Vectors without an id are clustered, but start no centroid unless
too few have one.  Repeated rows are vectors each.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

SCALE, COMPONENTS, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, 2
LARGEST = 1 << 17
#: Rows looked at together.
BLOCK = 4096
WRITTEN = "id long, x array<int>, cluster int, distance long, rows long, sums array<long>, inertia decimal(38,0)"


def integers(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """id, x of the vectors that take part."""
    v = F.col("v")
    ok = v.isNotNull() & (F.size(v) == components) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LARGEST)))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.coalesce(ok, F.lit(False)))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, centroids: int, seed: int) -> np.ndarray:
    """The vectors of smallest hash, in its order.

    Only rows below a hash that about eight times as many ids are expected under are ordered, so tasks send a few rows each; all are, should too few lie there.
    """
    hashed = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    order = [F.asc_nulls_last("hash"), "x"]
    n = rows.count()
    if n > 64 * centroids:
        cut = f"{min(int(8 * centroids / n * (1 << 60)), (1 << 60) - 1):015x}"
        some = hashed.where(F.substr("hash", F.lit(1), F.lit(15)) <= cut).orderBy(*order).select("x").limit(centroids).collect()
        if len(some) == centroids:
            return np.array([r["x"] for r in some], np.int64)
    return np.array([r["x"] for r in hashed.orderBy(*order).select("x").limit(centroids).collect()], np.int64)  # so many rows at most


def orders(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, d2): for each centroid the others from near to far (ties: smaller number), and their squared distances from it."""
    d2 = ((c[:, None] - c[None]) ** 2).sum(2)
    order = np.stack([[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(d2)]) if len(c) > 1 else np.zeros((len(c), 0), int)
    return order.astype(np.int64), np.take_along_axis(d2, order.astype(np.int64), 1) if len(c) > 1 else np.zeros((len(c), 0), np.int64)


def assign(x: np.ndarray, before: np.ndarray, c: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances computed) of each vector, from its centroid before.

    Vectors of one centroid scan the same order, so a step takes one centroid for all that haven't stopped: sorted by distance, a prefix.
    """
    near, far = before.copy(), np.empty(len(x), np.int64)
    seen = len(x)
    for own in np.unique(before):
        at = np.flatnonzero(before == own)
        d = ((x[at] - c[own]) ** 2).sum(1)
        falling = np.argsort(-d, kind="stable")
        at, start = at[falling], d[falling]
        best, which, points = start.copy(), np.full(len(at), own), x[at]
        reach = -4 * start  # rising
        for other, gap in zip(order[own], apart[own]):
            n = int(np.searchsorted(reach, -gap, "right"))  # those with gap <= 4 * start
            if not n:
                break
            seen += n
            e = ((points[:n] - c[other]) ** 2).sum(1)
            better = (e < best[:n]) | ((e == best[:n]) & (other < which[:n]))
            best[:n] = np.where(better, e, best[:n])
            which[:n] = np.where(better, other, which[:n])
        near[at], far[at] = which, best
    return near, far, seen


def _pass(table: DataFrame, c: np.ndarray) -> DataFrame:
    """The written table of one round: rows with their assignment, and each task's counts and sums by centroid."""
    order, apart = orders(c)
    k, d = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in WRITTEN.split(", ")]
        rows, sums, inertia = np.zeros(k, np.int64), np.zeros((k, d), np.int64), [0] * k
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = part.column(1).flatten().to_numpy().reshape(-1, d).astype(np.int64)
                near, far, _ = assign(x, part.column(2).to_numpy().astype(np.int64), c, order, apart)
                rows += np.bincount(near, minlength=k)
                np.add.at(sums, near, x)
                high, low = np.zeros(k, np.int64), np.zeros(k, np.int64)  # summed apart, as a sum may not fit
                np.add.at(high, near, far >> 32)
                np.add.at(low, near, far & 0xFFFFFFFF)
                inertia = [a + (h << 32) + b for a, h, b in zip(inertia, high.tolist(), low.tolist())]
                none = len(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near.astype(np.int32)), pa.array(far), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64())), pa.nulls(none, pa.decimal128(38))], names)
        held = np.flatnonzero(rows)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.list_(pa.int32())), pa.array(held.astype(np.int32)), pa.nulls(len(held), pa.int64()), pa.array(rows[held]), pa.array(list(sums[held]), pa.list_(pa.int64())), pa.array([Decimal(inertia[i]) for i in held], pa.decimal128(38))], names)

    return scratch.cut(table.select("id", "x", "cluster").mapInArrow(words.tidy(run), WRITTEN), "clusters")


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = SEED, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    table = scratch.cut(integers(vectors, components, vector, key).withColumn("cluster", F.lit(0)), "vectors")
    c = first_centroids(table, centroids, seed)
    if not len(c):
        return spark.createDataFrame([], names)
    exact = "decimal(38,0)"
    for _ in range(rounds):
        after = _pass(table, c)
        scratch.drop(table)
        table = after.where("rows is null")
        found = after.where("rows is not null").select("cluster", "rows", F.posexplode("sums").alias("k", "s")).groupBy("cluster", "k").agg(F.sum("rows").alias("n"), F.sum(F.col("s").cast(exact)).alias("s")).collect()  # centroids x components
        for r in found:
            c[r["cluster"], r["k"]] = int(r["s"]) // r["n"]
    done = _pass(table, c)
    scratch.drop(table)
    inertia = {r["cluster"]: int(r["i"]) for r in done.where("rows is not null").groupBy("cluster").agg(F.sum("inertia").alias("i")).collect()}  # a row for each centroid
    total = sum(inertia.values())
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(i, fits(inertia[i]), fits(total), digest(c[i])) for i in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.where("rows is null").select("id", "cluster", "distance").join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(table: str = "embeddings", centroids: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: int = SEED) -> str:
    """The same rows by brute force, for a table with distinct ids: every vector against every centroid, a part of the statement for each round."""
    near = "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.vec_id, m.c, sum((p.v - m.v) * (p.v - m.v)) AS d FROM p JOIN m{r} m ON p.k = m.k GROUP BY 1, 2) GROUP BY vec_id"
    parts = [
        f"kept AS (SELECT vec_id, embedding AS e FROM {table} WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, unnest(range({components})) AS k, CAST(floor({SCALE} * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS v FROM kept)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {centroids})",
        "m0 AS (SELECT c, k, v FROM p JOIN f USING (vec_id))",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"s{r} AS (SELECT c, k, sum(v) AS s, count(*) AS n FROM p JOIN a{r} USING (vec_id) GROUP BY 1, 2)")
        parts.append(f"m{r + 1} AS MATERIALIZED (SELECT m.c, m.k, CASE WHEN n IS NULL THEN m.v ELSE CAST((s - ((s % n) + n) % n) / n AS BIGINT) END AS v FROM m{r} m LEFT JOIN s{r} USING (c, k))")
    parts.append(f"last AS MATERIALIZED ({near.format(r=rounds)})")
    about = f"(SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS h FROM m{rounds} GROUP BY c)"
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM last JOIN {about} USING (c)"
