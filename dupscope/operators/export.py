"""Exports of groups and plans: files in order, written by many tasks.

Rows are sorted by ranges; each range is a part file, and the parts' names are in the order of the rows.  A header is a part of its own whose name
comes first, so the parts one after the other are the whole file, as they lie (``cat``) or joined by :func:`joined`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import groups

#: A part's name that comes before those of Spark's parts.
HEADER = "part--header"


def csv_rows(members: DataFrame) -> DataFrame:
    """group (from 0), keep, size_bytes, hash, path; the path is guarded against formulas."""
    keep = groups.keepers(members, "export").select("path").withColumn("keep", F.lit(True))
    return members.join(keep, "path", "left").select(F.col("rank").alias("group"), F.coalesce("keep", F.lit(False)).alias("keep"), F.col("size").alias("size_bytes"), "hash", text.csv_guard(F.col("path")).alias("path"))


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _header(spark: SparkSession, folder: str, line: str) -> None:
    fs, target = _fs(spark, f"{folder}/{HEADER}")
    stream = fs.create(target, True)
    stream.write(bytearray(f"{line}\n".encode()))
    stream.close()


def write_csv(members: DataFrame, path: str) -> None:
    """A folder of parts in order of group and path, the header first."""
    rows = csv_rows(members).repartitionByRange("group", "path").sortWithinPartitions("group", "path")
    rows.write.mode("overwrite").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    _header(members.sparkSession, path, ",".join(rows.columns))


def write_script(lines: DataFrame, path: str) -> None:
    """A folder of parts of a script (plan.script), in order."""
    order = ["section", "target", "step"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def joined(spark: SparkSession, folder: str, target: str) -> None:
    """The parts of a folder as one file: bytes are passed on as they are read, a buffer at a time."""
    fs, source = _fs(spark, folder)
    to, out = _fs(spark, target)
    names = sorted(f.getPath().getName() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
    jvm = spark.sparkContext._jvm
    stream = to.create(out, True)
    try:
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, stream, 1 << 16, False)
            finally:
                part.close()
    finally:
        stream.close()


def report_lines(group_rows: DataFrame, manifest: DataFrame, top: int = 50) -> DataFrame:
    """rank, path, line: the report of the first groups in this order; a line for each group (its path is empty) and one for each member."""
    first = group_rows.where(F.col("rank") < top)
    head = first.select("rank", F.lit("").alias("path"), F.concat(F.lit("#"), (F.col("rank") + 1).cast("string"), F.lit(": "), F.col("file_count").cast("string"), F.lit(" x "), text.human_bytes(F.col("size")), F.lit(", "), text.human_bytes(F.col("reclaim")), F.lit(" to free")).alias("line"))
    return head.union(report(group_rows, manifest, top).select("rank", "path", F.concat(F.lit("    "), text.terminal(F.col("path")))))


def report(group_rows: DataFrame, manifest: DataFrame, top: int = 50) -> DataFrame:
    """Members of the first groups."""
    return groups.members(manifest, group_rows.where(F.col("rank") < top))
