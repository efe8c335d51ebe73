"""Best-fit packing of token sequences into as few bins of a fixed capacity as best fit finds.

Method: bulk-synchronous best-fit.  Items are range-sorted by length, longest first, and bins by
gap.  One superstep takes all items of one length: a sweep over the sorted gaps matches them
to the successor (smallest gap that holds them), ranks within the length resolve which item
gets which bin, gaps are updated, and the next length follows.  Nothing but the length of an
item matters to the sweep, so its state is run-length coded: how many items have each length
and how many bins have each gap.  That is at most ``capacity`` numbers however many items
there are; the sweep runs over them in one place, and the items themselves (ranking, matching
of ranks to bins) stay distributed.  The result is that of sequential best-fit decreasing.

Null text is an empty text: it has its end id only.  Repeated rows are packed once each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens, words

#: Rows of one ranking task.
RANKED = 50_000
#: Runs up to which they are broadcast (48 bytes each); beyond, lengths join in a shuffle.
BROADCAST = 200_000


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end id, cut where longer than capacity."""
    path = tokenizer or tokens.default_path()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            data, at = words.buffers(batch.column(1))
            rows = []
            for doc, p, q in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                ids = enc.text(data[p:q].tobytes()) + end
                for piece, k in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc, piece, k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words.tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps over run-length coded items and gaps.

    Returns runs (length, first rank, end rank, first bin, bins, offset): of the items of that length, rank r in
    [first, end) goes to bin ``first bin + (r - first) % bins`` at ``offset + (r - first) // bins * length``.
    A step uses up a run of gaps or the items of a length, and has two runs at most.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # distinct gaps, ascending
    bins: dict[int, list[list[int]]] = {}  # gap -> runs of bins [first, count]
    made = 0

    def put(gap: int, first: int, count: int) -> None:
        if count and gap:
            if gap not in bins:
                bins[gap] = []
                insort(gaps, gap)
            bins[gap].append([first, count])

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                first, count = bins[gap][-1]
            else:
                gap, first, count = capacity, made, -(-left // (capacity // length))
                made += count
                put(gap, first, count)
            bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(bisect_left(gaps, gap))
            deep = gap // length
            full = min(count, left // deep)
            part = left - full * deep if full < count else 0  # the last bin takes what is left
            if full:
                runs.append((length, rank, rank + full * deep, first, full, capacity - gap))
                rank += full * deep
            put(gap - deep * length, first, full)
            if part:
                runs.append((length, rank, rank + part, first + full, 1, capacity - gap))
                rank += part
                put(gap - part * length, first + full, 1)
                full += 1
            put(gap, first + full, count - full)
            left = histogram[length] - rank
    return runs


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The runs of :func:`sweep` with one item for each bin: (length, first rank, end rank, first bin, offset)."""
    return [
        (length, r, r + bins, first, offset + j * length)
        for length, r0, r1, first, bins, offset in sweep(histogram, capacity)
        for j, r in enumerate(range(r0, r1, bins))
    ]


def place(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """items (doc_id, piece, length, ...), written tables best -> items with sequence_id and offset.

    A column row_, different in every row, keeps rows that share an id apart: they are ranked in many tasks.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = sweep(counts, capacity)
    salts = spark.createDataFrame([(k, -(-v // RANKED)) for k, v in counts.items()], "length long, salts long")
    salted = items.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", *[c for c in ("row_",) if c in items.columns]), F.col("salts"))).drop("salts")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = ranked.join(before, ["length", "salt"]).withColumn("r", F.col("r") + F.col("before")).drop("salt", "before")
    table = spark.createDataFrame(runs, "run_length long, r0 long, r1 long, bin0 long, bins long, offset0 long")
    if len(runs) <= BROADCAST:
        table = F.broadcast(table)
    placed = ranked.join(table, (F.col("length") == F.col("run_length")) & (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1")))
    at = F.col("r") - F.col("r0")
    return (
        placed.withColumn("sequence_id", F.col("bin0") + at % F.col("bins"))
        .withColumn("offset", F.col("offset0") + F.expr("(r - r0) div bins") * F.col("length"))
        .drop("run_length", "r0", "r1", "bin0", "bins", "offset0", "r")
    )


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    held = scratch.cut(pieces(docs, capacity, tokenizer, end_id).withColumn("row_", F.monotonically_increasing_id()), "pieces")
    return place(held, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
