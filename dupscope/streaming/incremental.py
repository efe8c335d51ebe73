"""Incremental scans: each micro-batch of walked rows inherits known hashes and is added to its scan once, however often it is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import files
from ..sources.store import Store


def added(store: Store, rows: DataFrame, stream: str, batch: int) -> bool:
    """One micro-batch: hashes are inherited from verified older scans; false if the batch had been added before."""
    known = store.read("file")
    fresh = rows.dropDuplicates(["scan_id", "path"]).withColumn("hash", F.lit(None).cast("string"))
    done = files.inherit(fresh, known.join(fresh.select("scan_id").distinct(), "scan_id", "left_anti"))
    return store.append("file", done.withColumn("identity_version", F.lit(1)), (stream, batch))


def scans(walked: DataFrame, store: Store, checkpoint: str) -> DataStreamWriter:
    """A writer for a stream of manifest rows (with scan_id).  The checkpoint names the stream: its batches are numbered, and a number is added once."""
    return walked.writeStream.foreachBatch(lambda rows, batch: added(store, rows, checkpoint, batch) and None).option("checkpointLocation", checkpoint)
