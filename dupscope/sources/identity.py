"""Hashes known by file identity: a bucketed table that joins without moving.

The index has one row for each identity (path, size and times) of verified files: the hash of the newest scan.  It is written in buckets of the identity, so a
scan that asks for its hashes is dealt to the buckets, and the history, however many scans it holds, is neither shuffled nor sorted again.
A new scan's hashes are merged the same way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.files import IDENTITY

KINDS = "path string, size long, mtime long, mtime_nsec long, ctime_sec long, ctime_nsec long, known_hash string, known_scan long"


class IdentityIndex:
    """An index at a location; opened again by the location and the number of buckets it was written with."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.location, self.buckets = spark, location.rstrip("/"), buckets
        self.name = ""

    def _open(self, location: str) -> None:
        self.name = f"identity_{uuid.uuid4().hex}"
        keys = ", ".join(IDENTITY)
        self.spark.sql(f"CREATE TABLE {self.name} ({KINDS}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{location}'")

    def _latest(self) -> str | None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.location)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.location}/{n}/_SUCCESS"))]
        return str(max(done)) if done else None

    def table(self) -> DataFrame:
        """The identity's columns, known_hash and known_scan."""
        latest = self._latest()
        if latest is None:
            return self.spark.createDataFrame([], KINDS)
        self._open(f"{self.location}/{latest}")
        return self.spark.table(self.name)

    def add(self, verified: DataFrame) -> None:
        """verified: scan_id, the identity, hash, identity_version.  For an identity the newest scan's hash stays; the version before stays until :meth:`table` finds this one whole."""
        fresh = verified.where("identity_version = 1 and hash is not null").groupBy(*IDENTITY).agg(F.max_by("hash", F.struct("scan_id", "hash")).alias("new_hash"), F.max("scan_id").alias("new_scan"))
        latest = self._latest()
        if latest is None:
            merged = fresh.withColumnsRenamed({"new_hash": "known_hash", "new_scan": "known_scan"})
        else:
            newer = F.col("known_scan").isNull() | (F.col("new_scan") >= F.col("known_scan"))
            both = self.table().join(fresh, list(IDENTITY), "full")
            merged = both.select(*IDENTITY, F.when(newer & F.col("new_hash").isNotNull(), F.col("new_hash")).otherwise(F.col("known_hash")).alias("known_hash"), F.greatest("known_scan", "new_scan").alias("known_scan"))
        name = f"identity_{uuid.uuid4().hex}"
        merged.write.bucketBy(self.buckets, *IDENTITY).sortBy(*IDENTITY).option("path", f"{self.location}/{int(latest or 0) + 1}").saveAsTable(name)

    def inherit(self, target: DataFrame) -> DataFrame:
        """target with missing hashes taken from the index, and inherited, whether one was."""
        out = target.join(self.table().drop("known_scan"), list(IDENTITY), "left")
        taken = F.col("hash").isNull() & F.col("known_hash").isNotNull()
        return out.withColumn("inherited", taken).withColumn("hash", F.coalesce("hash", "known_hash")).select(*target.columns, "inherited")
