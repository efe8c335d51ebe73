"""Whitening of vectors by principal components, from a one-sided Jacobi SVD.

Components become integers x = floor(64 c) + 1000000, so that sums over any number of rows are exact.  The fit list is each
distinct x once.

1. One pass over the fit list counts its n rows and sums each dimension (S, exact integers).
2. TSQR: every task centres its rows as (n x - S) / n, whose integers are exact, and takes them in blocks into a triangular R of the same
   cross products; the tasks' R are stacked and reduced again, FAN at a time, until at most FAN are left.
3. Plane rotations make the columns of the last R orthogonal (:func:`jacobi`).  The accumulated rotations are the
   components, the lengths of the columns over sqrt(n) the standard deviations.  No covariance is ever formed, so that small
   deviations keep their digits.
4. One pass projects all rows; another sums the products of the fit list's whitened columns for identity_error.

The driver holds a few d x d matrices, d the number of dimensions.  Copies of a vector, however many, are one row of the fit list; they are
counted away before the shuffle.

Vectors that are null, empty, or hold null, NaN or infinite entries take no part; nor do those of another number of dimensions than
most have (ties: the fewer), or with entries of over 2**40, which have no exact deviation as a long.  A deviation of over 2**63 - 1 is null.
Null and repeated ids keep their rows.  Components without spread (fewer distinct vectors than dimensions, constant dimensions) can't be
whitened and are left out, so a table with one distinct vector gives no rows.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, words

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Rows taken into R at a time, and R matrices reduced together.
BLOCK, FAN = 4096, 64
#: Sweeps of rotations at most; columns count as orthogonal below so many units of rounding.
SWEEPS, UNITS = 60, 4
LARGEST = 1 << 40


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST))), F.lit(False))


def integers(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """id, x of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    x = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"))  # one row
    return rows.join(F.broadcast(most), F.size("v") == F.col("d")).select("id", x.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def totals(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Rows of the fit list and the sums of its dimensions, exact.  Each task sends d sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                s = [a + b for a, b in zip(s, matrix(batch.column(0), d).sum(0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s, pa.int64())], ["k", "n", "s"])

    rows = fit.select("x").mapInArrow(run, "k int, n long, s long").groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()  # d rows
    return int(rows[0]["n"]), np.array([int(r["s"]) for r in rows], object)


def centred(x: np.ndarray, n: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, exact, and the same over n as doubles."""
    largest = n * int(max(abs(int(x.max())), abs(int(x.min())))) + int(max(map(abs, s))) if len(x) else 0
    exact = n * x - s.astype(np.int64) if largest < 1 << 62 else n * x.astype(object) - s
    return exact, np.asarray(exact / n, float)


def reduced(rows: DataFrame, d: int, n: int, s: np.ndarray) -> np.ndarray:
    """The triangular R of the centred fit list: R'R is the sum of its cross products."""

    def absorb(r: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, block]), "r")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, any_ = np.zeros((0, d)), False
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                r, any_ = absorb(r, centred(matrix(batch.column(0).slice(i, BLOCK), d), n, s)[1]), True
        if any_:
            yield packed(TaskContext.get().partitionId(), r)

    def packed(group: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, r = None, np.zeros((0, d))
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part // FAN != group:
                    if group is not None:
                        yield packed(group, r)
                    group, r = part // FAN, np.zeros((0, d))
                r = absorb(r, np.frombuffer(data).reshape(-1, d))
        if group is not None:
            yield packed(group, r)

    made = scratch.cut(rows.select("x").mapInArrow(words.tidy(first), "part long, r binary"), "tsqr")
    while made.count() > FAN:
        above = scratch.cut(made.repartition(F.floor(F.col("part") / FAN)).sortWithinPartitions("part").mapInArrow(words.tidy(again), "part long, r binary"), "tsqr")
        scratch.drop(made)
        made = above
    last = sorted(made.collect(), key=lambda x: x["part"])  # FAN rows of d x d at most
    scratch.drop(made)
    r = np.zeros((0, d))
    for row in last:
        r = absorb(r, np.frombuffer(row["r"]).reshape(-1, d))
    return r


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, V): the columns of r V are orthogonal, of falling lengths.

    A sweep rotates every pair of columns once, in rounds of disjoint pairs (one column stays, the others move round), until no pair of a sweep needed it.
    """
    d = r.shape[1]
    even = d + d % 2
    u, v = np.zeros((len(r), even)), np.eye(even)
    u[:, :d] = r
    ring = np.arange(even)
    small = UNITS * np.finfo(float).eps * np.sqrt(max(u.shape))
    for _ in range(SWEEPS):
        turned = 0
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[::-1][: even // 2]
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            go = (np.abs(ab) > small * np.sqrt(aa * bb)) & (ab != 0)
            turned += int(go.sum())
            if go.any():
                p, q, aa, bb, ab = p[go], q[go], aa[go], bb[go], ab[go]
                zeta = (bb - aa) / (2 * ab)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                for m in (u, v):
                    x, y = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    length = np.sqrt((u * u).sum(0))[:even]
    order = [k for k in np.argsort(-length, kind="stable") if k < d or length[k] > 0][:d]
    return length[order], v[:d, order]


def whiten(vectors: DataFrame, components: int = 16, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: rows for each vector that takes part."""
    spark = vectors.sparkSession
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = scratch.cut(integers(vectors, vector, key), "integers")
    fit = scratch.cut(rows.select("x").distinct(), "fit")
    some = fit.first()
    if some is None:
        return spark.createDataFrame([], names)
    d = len(some["x"])
    n, s = totals(fit, d)
    length, v = jacobi(reduced(fit, d, n, s))
    spread = length > (length[0] if len(length) else 0) * max(n, d) ** 0.5 * np.finfo(float).eps
    k = min(components, int(spread.sum()))
    if not k:
        return spark.createDataFrame([], names)
    deviation = length / np.sqrt(n)
    explained = (deviation**2 / (deviation**2).sum())[:k]
    to_white = v[:, :k] / deviation[:k]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((k, k)), False
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                white = centred(matrix(batch.column(0).slice(i, BLOCK), d), n, s)[1] @ to_white
                total, any_ = total + white.T @ white, True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["at", "p"])

    sums = fit.mapInArrow(words.tidy(products), "at int, p double").groupBy("at").agg(F.sum("p").alias("p")).collect()  # k * k rows
    covariance = np.zeros(k * k)
    for r in sums:
        covariance[r["at"]] = r["p"] / n
    error = float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                exact, real = centred(matrix(part.column(1), d), n, s)
                if exact.dtype == object or d * int(max(abs(int(exact.max())), abs(int(exact.min())))) ** 2 >= 1 << 63:
                    squares = [int(x) for x in (exact.astype(object) ** 2).sum(1)]
                else:
                    squares = (exact * exact).sum(1).tolist()
                away = pa.array([x if x < 1 << 63 else None for x in squares], pa.int64())
                at = pa.array(np.repeat(np.arange(len(real)), k))
                size = len(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(real))), pa.array(np.full(size, n)), away.take(at), pa.array((real @ to_white).ravel()), pa.array(np.tile(explained, len(real))), pa.array(np.full(size, error))], [f.split()[0] for f in names.split(", ")])

    return rows.mapInArrow(words.tidy(project), names)
