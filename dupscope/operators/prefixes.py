"""Paths looked up in a sorted index: is a path there, and is anything below it?

The index is the paths sorted by ranges, one folder of files for each range, and the first path of each range.  A path is there if its successor in the
order (the first path not before it) is itself; a directory has something below if the successor of ``directory/`` begins
with that.  Asked paths are dealt to their ranges and only those ranges are read; the indexed paths are neither exploded into
their ancestors nor shuffled again, so an index is made once and asked many times.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..sources import scratch


@dataclass
class Index:
    #: cell_, path: a written table with a folder for each range.
    table: DataFrame
    #: The ranges' first paths in order, and their numbers: one for each range.
    firsts: list[str]
    cells: list[int]


def index(manifest: DataFrame) -> Index:
    cell = F.shiftright(F.monotonically_increasing_id(), 33).cast("int")
    sorted_ = manifest.select("path").where("path is not null").repartitionByRange("path").sortWithinPartitions("path").withColumn("cell_", cell)
    table = scratch.cut(sorted_, "paths", by=("cell_",))
    first = sorted((r["first"], r["cell_"]) for r in table.groupBy("cell_").agg(F.min("path").alias("first")).collect())  # a row for each range
    return Index(table, [f for f, _ in first], [c for _, c in first])


def _placed(at: Index, asked: DataFrame, key: str) -> DataFrame:
    """asked with cell_, the range that its key lies in (the first range for what lies before all), and next_, the first path of the range after."""
    place = asked.columns.index(key)
    firsts, cells = at.firsts, at.cells
    schema = StructType([*asked.schema.fields, StructField("cell_", IntegerType()), StructField("next_", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [max(0, bisect_right(firsts, k) - 1) if k is not None and firsts else None for k in batch.column(place).to_pylist()]
            own = [None if i is None else cells[i] for i in found]
            after = [firsts[i + 1] if i is not None and i + 1 < len(firsts) else None for i in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(after, pa.string())], [*batch.schema.names, "cell_", "next_"])

    return asked.mapInArrow(run, schema)


def successors(at: Index, asked: DataFrame, key: str, name: str) -> DataFrame:
    """asked with the first path of the index that isn't before key; null if there is none, or no key."""
    placed = scratch.cut(_placed(at, asked, key), "placed")
    wanted = [r["cell_"] for r in placed.where("cell_ is not null").select("cell_").distinct().collect()]  # a number for each range at most
    # Within a range, asked rows see the indexed paths from the last one back; equal ones first.
    row = F.struct(*[F.col(c) for c in placed.columns])
    probes = placed.select("cell_", F.col(key).alias("at_"), F.lit(1).alias("kind_"), row.alias("row_"), F.lit(None).cast("string").alias("found_"))
    known = at.table.where(F.col("cell_").isin(wanted)).select("cell_", F.col("path").alias("at_"), F.lit(0).alias("kind_"), F.lit(None).cast(probes.schema["row_"].dataType).alias("row_"), F.col("path").alias("found_"))
    back = Window.partitionBy("cell_").orderBy(F.desc("at_"), "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = known.unionByName(probes).withColumn("found_", F.last("found_", ignorenulls=True).over(back)).where("kind_ = 1")
    return seen.select("row_.*", "found_").withColumn(name, F.coalesce("found_", "next_")).select(*asked.columns, name)


def covered(at: Index, asked: DataFrame) -> DataFrame:
    """asked (path) with covered: whether it is a path of the index or one lies below it.  Null and empty paths aren't."""
    inner = F.when(F.col("path") == "/", F.lit("/")).otherwise(F.concat("path", F.lit("/")))
    probes = asked.select("path").distinct().withColumn("probe_", F.explode(F.array("path", inner)))
    hit = F.col("path") != ""
    hit &= (F.col("found_in_") == F.col("path")) | F.col("found_in_").startswith(inner)
    marked = successors(at, probes, "probe_", "found_in_").groupBy("path").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("covered"))
    return asked.join(marked, "path", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
