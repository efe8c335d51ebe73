"""Samples of a fixed size that are the same on every run and grow no task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows expected below the threshold, for each row of the sample.
SPARE = 4


def first_by_hash(rows: DataFrame, hash_: Column, k: int, *ties: str) -> DataFrame:
    """The k rows of smallest hash (a long of even spread), ties by columns.

    Rows are counted first, and only those below a threshold that leaves SPARE * k of them are ordered, so what tasks send to be merged is bounded for all of them
    together and not for each.  Where hashes of few values leave fewer than k, all rows are ordered: the sample is the same.
    """
    n = rows.count()
    ordered = lambda df: df.withColumn("hash_", hash_).orderBy("hash_", *ties).limit(k).drop("hash_")
    if n > 2 * SPARE * k:
        below = rows.where(hash_ <= -(1 << 63) + (SPARE * k << 64) // n)
        if below.limit(k).count() == k:
            return ordered(below)
    return ordered(rows)
