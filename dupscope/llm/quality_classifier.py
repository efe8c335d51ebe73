"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's vector x has ``HASHED`` entries for hashed words (counts, scaled to length 1) and a few
standardised figures of structure (shares of capitals, symbols, digits, bars, line and word
lengths, ...) and size.  The score is the logistic of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

the pairs by the identity ``((sum_i v_i x_i)^2 - sum_i v_i^2 x_i^2) / 2`` in time linear in the
entries.  Labels, lang, source and doc_id are never in x.

It is fitted on a bounded sample of labelled rows (``TRAIN_ROWS`` in hash order of doc_id, a
documented bound) by Adam on the driver; every row is then scored whole.  The sample's vectors
and the model (``HASHED * (RANK + 1)`` floats) are all that ever is in one place.

Null and empty texts have an all-zero word part and are scored like any other.  Without labels
the score is 0.5; with labels of one kind, near that label.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling, words

HASHED, RANK = 4096, 8
TRAIN_ROWS, EPOCHS, BATCH, SEED = 6000, 12, 128, 7
CUT = 0.7
#: Texts whose dense vectors are held together.
TOGETHER = 256

_kinds = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&<>@^_=+\\/{}[]~`", "bar": b"|", "stop": b".!?", "bang": b"!", "comma": b",;:", "high": range(128, 256), "space": b" \t\n\x0b\x0c\r", "line": b"\n"}
KIND = np.zeros((256, len(_kinds)), np.float32)
for _k, _bytes in enumerate(_kinds.values()):
    KIND[list(_bytes), _k] = 1
STRUCTURE = len(_kinds) + 7


class Model(NamedTuple):
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over at[i]..at[i+1]."""
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    return run[at[1:]] - run[at[:-1]]


def vectors(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the part, hashed word) of each word, and the structure figures, for parts of at most TOGETHER texts."""
    data, offsets = words.buffers(column)
    for i, j in words.slices(offsets):
        for k in range(i, j, TOGETHER):
            m = min(j, k + TOGETHER)
            b, s, e, first = words.spans(data, offsets, k, m)
            h = words.word_hashes(b, s, e)
            n = np.diff(first)
            rows = np.repeat(np.arange(m - k), n)
            at = offsets[k : m + 1] - offsets[k]
            size = np.maximum(np.diff(at), 1)[:, None]
            kinds = np.stack([_per_text(KIND[b, c], at) for c in range(KIND.shape[1])], 1)
            length = (e - s).astype(np.float64)
            many = np.maximum(n, 1)
            mean = _per_text(length, first) / many
            spread = np.sqrt(np.maximum(_per_text(length**2, first) / many - mean**2, 0))
            same = np.zeros(len(h))
            same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
            distinct = np.zeros(m - k)
            if len(h):
                pair = np.lexsort((h, rows))
                distinct = np.bincount(rows[pair][np.concatenate([[True], (h[pair][1:] != h[pair][:-1]) | (rows[pair][1:] != rows[pair][:-1])])], minlength=m - k)
            figures = np.column_stack([kinds / size, np.log1p(size[:, 0]), np.log1p(n), mean, spread, _per_text(same, first) / many, distinct / many, kinds[:, 10] / many])
            yield rows, (h & words.U(HASHED - 1)).astype(np.int64), figures


def _dense(rows: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    x = np.bincount(rows * HASHED + hashed, minlength=n * HASHED).reshape(n, HASHED).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _forward(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    xv = x @ v
    return w0 + x @ w + 0.5 * (xv**2 - (x * x) @ (v * v)).sum(1), xv


def score(model: Model, column) -> np.ndarray:
    out = []
    for rows, hashed, figures in vectors(column):
        z = np.clip((figures - model.mean) / model.deviation, -5, 5).astype(np.float32)
        x = np.concatenate([_dense(rows, hashed, len(figures)), z], 1)
        out.append(1 / (1 + np.exp(-np.clip(_forward(x, model.w0, model.w, model.v)[0], -30, 30))))
    return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def fit(parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """parts: (hashed words, structure figures) of each labelled text."""
    rng = np.random.default_rng(SEED)
    d = HASHED + STRUCTURE
    if not len(y):
        return Model(0.0, np.zeros(d, np.float32), np.zeros((d, RANK), np.float32), np.zeros(STRUCTURE), np.ones(STRUCTURE))
    figures = np.stack([p[1] for p in parts])
    mean, deviation = figures.mean(0), np.maximum(figures.std(0), 1e-6)
    z = np.clip((figures - mean) / deviation, -5, 5).astype(np.float32)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, RANK)).astype(np.float32)
    # Rows of the rarer label weigh more, so that both count.
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    moments = [[np.zeros_like(np.asarray(p, np.float32)) for p in (w0, w, v)] for _ in range(2)]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = 0.02 / (1 + epoch / 4)
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            which = np.repeat(np.arange(len(rows)), [len(parts[r][0]) for r in rows])
            x = np.concatenate([_dense(which, np.concatenate([parts[r][0] for r in rows]), len(rows)), z[rows]], 1)
            out, xv = _forward(x, w0, w, v)
            g = (weight[rows] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            gx = x * g[:, None]
            grads = [g.sum(), x.T @ g + 1e-4 * w, gx.T @ xv - v * (gx * x).sum(0)[:, None] + 1e-3 * v]
            step += 1
            new = []
            for i, (p, q) in enumerate(zip((w0, w, v), grads)):
                moments[0][i] = 0.9 * moments[0][i] + 0.1 * q
                moments[1][i] = 0.999 * moments[1][i] + 0.001 * q * q
                new.append(p - rate * (moments[0][i] / (1 - 0.9**step)) / (np.sqrt(moments[1][i] / (1 - 0.999**step)) + 1e-8))
            w0, w, v = float(new[0]), new[1].astype(np.float32), new[2].astype(np.float32)
    return Model(w0, w, v, mean, deviation)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known(labels: DataFrame) -> DataFrame:
    """The labels that a model may learn from."""
    return labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows that aren't held out."""
    sample = sampling.first_by_hash(known(labels).groupBy("doc_id").agg(F.max("quality").alias("y")), F.xxhash64("doc_id"), rows, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed, figures = [], []
            for at, h, f in vectors(batch.column(1)):
                hashed += [h[at == i].astype("<u2").tobytes() for i in range(len(f))]
                figures += [list(x) for x in f]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hashed, pa.binary()), pa.array(figures, pa.list_(pa.float64()))], ["doc_id", "y", "hashed", "figures"])

    # `rows` ids and labels at most: a proven bound for the broadcast.
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("y").cast("int"))
    got = joined.mapInArrow(run, "doc_id long, y int, hashed binary, figures array<double>").toArrow().sort_by("doc_id")
    parts = [(np.frombuffer(h, "<u2").astype(np.int64), np.array(f)) for h, f in zip(got["hashed"].to_pylist(), got["figures"].to_pylist())]
    return fit(parts, got["y"].to_numpy().astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """docs' columns, held_out_, score_, predicted_ (1 if score_ >= cut).

    Columns of docs with one of the three names are replaced.  Repeated rows each get a row.  Without labelled
    rows nothing is known: all scores are 0.5, which is below CUT.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    made = ("held_out_", "score_", "predicted_")
    names = [c for c in docs.columns if c not in made]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(Model(*held.value), batch.column(names.index("text"))))], [*names, "score_"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = docs.mapInArrow(words.tidy(run), f"{schema}, score_ double")
    return scored.withColumns({"held_out_": held_out(F.col("doc_id")), "predicted_": (F.col("score_") >= cut).cast("int")})
