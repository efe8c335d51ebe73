"""Token counts of documents in flat token files that have no index, only end-of-document ids.

Method: separator scan.  Files are taken as blocks of a fixed number of ids, cut wherever they
fall.  Each block is searched for the end id with one vector comparison.  A document that
crosses blocks is stitched by a prefix scan over the blocks of a file: ids before the block,
end ids before it, and the place of the last end id before it (scanned within runs of blocks,
then over the runs, so that one huge file isn't one task).

Blocks come from :func:`write` (a table of raw little-endian uint16 ids made from texts) or from
:func:`read_files` (flat files of uint16 or uint32 ids in any store that Spark reads, by byte ranges where Arrow opens it).
:func:`write` refuses tokenizers whose ids need more than 16 bits.
Null or empty text: no ids, an end id only, count 0.  Repeated rows are counted once each.  Ids after a file's last end id are a
document that isn't ended; it is returned with ``ended`` false.  Empty files have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch, tokens, words

#: Ids in a block; blocks in a run of the prefix scan.
BLOCK, RUN = 1 << 19, 1024
#: Blocks of a file that one task reads.
PER_TASK = 64
END = 49407


def write(docs: DataFrame, tokenizer: str | None = None, end_id: int = END) -> DataFrame:
    """Flat files of docs (doc_id, text), one of each task: file, block, ids (binary); beside them file, block, doc_ids.

    The ids hold nothing of where documents begin.  doc_ids, kept apart, are the documents of a
    file in order, to name the counts.
    """
    path = tokenizer or tokens.default_path()
    largest = max(tokens.largest_id(path), end_id)
    if largest > 0xFFFF:
        raise ValueError(f"ids up to {largest} don't fit in the 16 bits of a token file")
    end = np.array([end_id], "<u2").tobytes()
    types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    names = ["file", "block", "ids", "doc_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, literal=True)
        file = TaskContext.get().partitionId()
        held, block, listed = bytearray(), 0, 0
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, types)], names)
        for batch in batches:
            data, at = words.buffers(batch.column(1))
            for p, q in zip(at[:-1].tolist(), at[1:].tolist()):
                held += np.frombuffer(enc.text(data[p:q].tobytes()), "<u4").astype("<u2").tobytes() + end
                while len(held) >= 2 * BLOCK:
                    yield row(file, block, bytes(held[: 2 * BLOCK]), None)
                    del held[: 2 * BLOCK]
                    block += 1
            yield row(file, listed, None, batch.column(0).to_pylist())
            listed += 1
        if held:
            yield row(file, block, bytes(held), None)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words.tidy(run), "file long, block int, ids binary, doc_ids array<long>")
    return scratch.cut(made, "tokens")


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path, folder or glob names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for top in fs.globStatus(target) or ():
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else (top,):
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                found.append((f.getPath().toString(), f.getLen()))
    return found


def _opened(path: str) -> tuple:
    """(Arrow's view of a path's store, the path in it); raises for stores that Arrow can't open."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":") if ":" in path.split("/", 1)[0] else ("file", "", path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _by_ranges(path: str) -> bool:
    try:
        _opened(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False


def read_files(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """file (number by path), path, block, ids of flat files of width-byte ids.

    Files are read by byte ranges of PER_TASK blocks, each a row that is dealt to any task, so files of any size are many tasks' work, one block in memory.
    Files in stores that only Spark can open are read whole, each in one task, and may have 2 GB at most.  Empty files have no rows.
    """
    size = width * BLOCK
    ranged, whole = [], []
    for name, length in _listed(spark, path):
        if not _by_ranges(name):
            whole.append(name)
        else:
            ranged += [(name, length, at) for at in range(0, -(-length // size), PER_TASK)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, name, length, first in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = _opened(name)
                with store.open_input_file(inner) as f:
                    for block in range(first, min(first + PER_TASK, -(-length // size))):
                        data = f.read_at(min(size, length - block * size), block * size)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((file, name, block, data), kinds)], ["file", "path", "block", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, name, data in zip(*(c.to_pylist() for c in batch.columns)):
                for block, k in enumerate(range(0, len(data), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((file, name, block, data[k : k + size]), kinds)], ["file", "path", "block", "ids"])

    kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary())
    names = "file long, path string, block int, ids binary"
    parts = spark.createDataFrame(ranged, "path string, length long, first long").repartition(max(1, min(len(ranged), scratch.partitions(spark) * 8)), "path", "first")
    out = parts.select(F.xxhash64("path").alias("file"), "path", "length", "first").mapInArrow(read, names)
    if whole:
        files = spark.read.format("binaryFile").load(whole).select(F.xxhash64("path").alias("file"), "path", "content")
        out = out.union(files.mapInArrow(cut, names))
    return out


def scan(blocks: DataFrame, end_id: int = END, width: int = 2) -> DataFrame:
    """file, block, length, ends (places of end ids in the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, f"<u{width}") for x in batch.column(2).to_pylist()]
            ends = [np.flatnonzero(x == end_id) for x in found]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ends)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *ends]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), lists], ["file", "block", "length", "ends"])

    return blocks.select("file", "block", "ids").mapInArrow(run, "file long, block int, length long, ends array<int>")


def stitched(scanned: DataFrame) -> DataFrame:
    """scanned, with what lies before each block of its file: before (ids), ended (end ids), last (place of the last end id, -1 if none)."""
    runs = scanned.withColumn("run", F.floor(F.col("block") / RUN))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    size, count = F.col("length"), F.size("ends").cast("long")
    part = runs.withColumns({"b": F.coalesce(F.sum(size).over(inside), F.lit(0)), "e": F.coalesce(F.sum(count).over(inside), F.lit(0))})
    own = F.when(F.size("ends") > 0, F.col("b") + F.element_at("ends", -1))
    part = part.withColumn("l", F.max(own).over(inside))
    total = part.groupBy("file", "run").agg(F.sum(size).alias("run_length"), F.sum(count).alias("run_ends"), F.max(own).alias("run_last"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumns({"rb": F.coalesce(F.sum("run_length").over(over), F.lit(0)), "re": F.coalesce(F.sum("run_ends").over(over), F.lit(0))})
    total = total.withColumn("rl", F.coalesce(F.max(F.col("rb") + F.col("run_last")).over(over), F.lit(-1)))
    both = part.join(total.select("file", "run", "rb", "re", "rl"), ["file", "run"])
    return both.select("file", "block", "length", "ends", (F.col("rb") + F.col("b")).alias("before"), (F.col("re") + F.col("e")).alias("ended"), F.coalesce(F.col("rb") + F.col("l"), F.col("rl")).alias("last"))


def counts(blocks: DataFrame, end_id: int = END, width: int = 2) -> DataFrame:
    """file, ordinal, n_tokens, ended of every document of flat files (end ids aren't counted)."""
    s = scratch.cut(stitched(scratch.cut(scan(blocks, end_id, width), "ends")), "stitched")
    one = s.select("file", "before", "ended", "last", "ends", F.posexplode("ends").alias("k", "at"))
    previous = F.when(F.col("k") == 0, F.col("last") - F.col("before")).otherwise(F.get("ends", F.col("k") - 1))
    done = one.select("file", (F.col("ended") + F.col("k")).alias("ordinal"), (F.col("at") - previous - 1).cast("long").alias("n_tokens"), F.lit(True).alias("ended"))
    tail = s.groupBy("file").agg(F.max(F.col("before") + F.col("length")).alias("size"), F.max(F.col("ended") + F.size("ends")).alias("ordinal"), F.max(F.when(F.size("ends") > 0, F.col("before") + F.element_at("ends", -1)).otherwise(F.col("last"))).alias("last"))
    rest = tail.where("size - last - 1 > 0").select("file", "ordinal", (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return done.union(rest)


def of_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END) -> DataFrame:
    """doc_id, n_tokens, file, ordinal: writes the texts as flat token files and counts by scanning them."""
    made = write(docs, tokenizer, end_id)
    ids = made.where("doc_ids is not null").select("file", "block", F.size("doc_ids").cast("long").alias("n"), "doc_ids")
    first = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    named = ids.withColumn("first", F.coalesce(first, F.lit(0))).select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return counts(made.where("ids is not null"), end_id).join(named, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
