"""Places in a whole order, without a task that sees all rows.

Rows are sorted by ranges into a written table, where each takes the number of its partition and its place there.  A place in the whole order is
then the rows of the partitions before, one count for each partition, plus the place within.  There are as many ranges as shuffle partitions, so they
grow with the cluster's setting, and a value that many rows share is cut by the rest of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: A key with more rows than this has its places from the sorted table, others from a window over the key.
LARGE = 1_000_000


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """rows with their place in the order, which no two rows share; a written table with its partitions in cell_ is read."""
    at = F.monotonically_increasing_id()
    table = scratch.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"cell_": F.shiftright(at, 33), "in_": at.bitwiseAND((1 << 33) - 1)}), "ranked")
    counts = table.groupBy("cell_").agg(F.count(F.lit(1)).alias("n_"))  # a row for each partition
    before = F.coalesce(F.sum("n_").over(Window.orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.join(F.broadcast(counts.select("cell_", before.alias("before_"))), "cell_").withColumn(name, F.col("before_") + F.col("in_") + start).drop("before_", "in_")


def by_benefit(rows: DataFrame, value: str, digest: str, start: int) -> DataFrame:
    """rows with rank: largest value first, ties by digest."""
    return numbered(rows, [F.desc(value), F.asc(digest)], "rank", start).drop("cell_")


def by_order(rows: DataFrame, order: Column, name: str, start: int = 1) -> DataFrame:
    """rows with their place in the order, which no two rows share."""
    return numbered(rows.withColumn("key_", order), [F.asc("key_")], name, start).drop("key_", "cell_")


def within(rows: DataFrame, key: list[str], order: str, name: str, large: int | None = None) -> DataFrame:
    """rows with their place (from 1) among the rows of a key.

    Rows are used twice and should come from a table.  The keys of more than LARGE rows, of which there is at most one for so many rows,
    are told to all tasks; their rows are numbered in the sorted table, so none of them meets in a task.
    """
    large = LARGE if large is None else large
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    many = scratch.cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > large).select(*key, F.lit(True).alias("many_")), "large")
    if many.isEmpty():
        return rows.withColumn(name, place)
    marked = _null_safe(rows, F.broadcast(many), key, "left")
    few = marked.where("many_ is null").drop("many_").withColumn(name, place)
    sorted_ = numbered(marked.where("many_").drop("many_"), [F.asc(k) for k in key] + [F.asc(order)], "at_").drop("cell_")
    first = sorted_.groupBy(*key).agg(F.min("at_").alias("first_"))  # a row for each large key
    return few.unionByName(_null_safe(sorted_, F.broadcast(first), key, "inner").withColumn(name, (F.col("at_") - F.col("first_") + 1).cast("int")).drop("at_", "first_"))


def _null_safe(rows: DataFrame, other: DataFrame, key: list[str], how: str) -> DataFrame:
    named = other.withColumnsRenamed({k: f"{k}__" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in key]
    return rows.join(named, same, how).drop(*[f"{k}__" for k in key])
