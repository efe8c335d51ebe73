"""Filters of the manifest, hashing candidates, reuse of hashes and their guarded commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import folds, ranks

#: What a scan leaves out unless told otherwise.
DEFAULT_EXCLUDES = ["**/.zfs/**", "**/.snapshots/**", "**/.quarantine/**"]
IDENTITY = ("path", "size", "mtime", "mtime_nsec", "ctime_sec", "ctime_nsec")


def directories(rows: DataFrame) -> DataFrame:
    """Of a listing, the directories."""
    return rows.where("kind = 'dir'")


def filtered(manifest: DataFrame, min_size: int = 4096, max_size: int | None = None, extensions: tuple[str, ...] = (), exclude: list[str] | None = None) -> DataFrame:
    out = manifest.where(F.col("size") >= min_size)
    if max_size is not None:
        out = out.where(F.col("size") <= max_size)
    if extensions:
        out = out.where(paths.extension(F.col("path")).isin(*extensions))
    if exclude is None or exclude:
        out = out.where(~paths.excluded(F.col("path"), DEFAULT_EXCLUDES if exclude is None else exclude))
    return out


def shared_sizes(manifest: DataFrame) -> DataFrame:
    """Rows whose size occurs at least twice; sizes are counted before the shuffle."""
    twice = manifest.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return manifest.join(twice.select("size"), "size", "left_semi")


def candidates(manifest: DataFrame) -> DataFrame:
    return shared_sizes(manifest).where("hash is null")


def candidate_stats(manifest: DataFrame) -> DataFrame:
    hashed = F.col("hash").isNotNull()
    return shared_sizes(manifest).agg(
        F.count(F.lit(1)).alias("files_total"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_total"),
        F.count("hash").alias("files_hashed"),
        F.coalesce(F.sum(F.when(hashed, F.col("size"))), F.lit(0)).alias("bytes_hashed"),
    )


def read_order(files: DataFrame, parts: int) -> DataFrame:
    """By device and inode, for reading without seeks."""
    return files.repartitionByRange(parts, "device", "inode").sortWithinPartitions("device", "inode")


def inherit(target: DataFrame, verified: DataFrame, key: tuple[str, ...] = IDENTITY) -> DataFrame:
    """target with missing hashes taken from verified rows of other scans with the same identity; the newest scan wins.

    verified: scan_id, the key, hash, identity_version.  The source is reduced to one row for each key first.
    """
    source = verified.where("identity_version = 1 and hash is not null").groupBy(*key).agg(F.max_by("hash", "scan_id").alias("old_hash"))
    out = target.join(source, list(key), "left")
    taken = F.col("hash").isNull() & F.col("old_hash").isNotNull()
    return out.withColumn("inherited", taken).withColumn("hash", F.coalesce("hash", "old_hash")).drop("old_hash")


def commit(manifest: DataFrame, hashed: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """manifest with the hashes of rows whose identity still matches; hashed: identity, new_hash."""
    out = manifest.join(hashed, list(identity), "left")
    return out.withColumn("committed", F.col("hash").isNull() & F.col("new_hash").isNotNull()).withColumn("hash", F.coalesce("hash", "new_hash")).drop("new_hash")


def listing(manifest: DataFrame, directory: str) -> DataFrame:
    """Children of a directory: name, kind, size, mtime; sub-directories have their files' sizes together."""
    path, depth = F.col("path"), 1 if directory == "/" else len(directory.split("/"))
    rest = F.slice(F.split(path, "/"), depth + 1, 1 << 20)
    inside = manifest.where(paths.below(path, directory)).select(rest[0].alias("name"), (F.size(rest) == 1).alias("is_file"), "size", "mtime", "hash")
    return inside.groupBy("name", "is_file").agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.max(F.when(F.col("is_file"), F.col("hash"))).alias("hash")).select("name", F.when(F.col("is_file"), "file").otherwise("dir").alias("kind"), "size", "mtime", "hash")


def with_parent(rows: DataFrame, directory: str) -> DataFrame:
    """A listing with the row ``..`` of the directory above, which the root doesn't have."""
    if directory == "/":
        return rows
    up = {"name": F.lit(".."), "kind": F.lit("parent")}
    return rows.union(rows.sparkSession.range(1).select(*[up.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))


def _listing_order(key: str) -> list[Column]:
    by = {"name": [], "size": [F.desc("size")], "type": [F.asc(paths.extension(F.col("name")))], "date": [F.desc("mtime")]}[key]
    return [F.asc(F.when(F.col("kind") == "parent", 0).when(F.col("kind") == "dir", 1).otherwise(2)), *by, F.asc("name")]


def sorted_listing(rows: DataFrame, key: str = "name") -> DataFrame:
    """The row of the directory above, directories, then files; each by name, size (largest first), type or date (newest first)."""
    return rows.orderBy(*_listing_order(key))


def placed_listing(rows: DataFrame, key: str = "name") -> DataFrame:
    """rows with their place (from 1) in that order."""
    return ranks.numbered(rows, _listing_order(key), "place", 1).drop("cell_")


def progress(rows: DataFrame, by: str, at: str, done: str, total: str) -> DataFrame:
    """Smoothed rate and time left of each series: a fold over its ordered rows, however long it is.

    inst = bytes since the last row / seconds (0 within half a second); ema = inst first, then 0.7 ema + 0.3 inst.
    """
    rate = F.coalesce(F.col("ema"), F.lit(0.0))
    return folds.rates(rows, by, at, done, total).select(by, rate.alias("rate"), F.when(rate > 1, (F.col("total") - F.col("d")) / rate).alias("eta"))


def dedup_attributes(manifest: DataFrame) -> DataFrame:
    """manifest with copies (rows of its hash), devices (1, or 2 for more than one) and twins (rows of its size and mtime)."""
    copies = manifest.where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.when(F.min("device") == F.max("device"), 1).otherwise(2).alias("devices"))
    stat = manifest.groupBy("size", "mtime").agg(F.count(F.lit(1)).alias("twins"))
    same = F.col("size").eqNullSafe(F.col("size_")) & F.col("mtime").eqNullSafe(F.col("mtime_"))
    out = manifest.join(copies, "hash", "left").join(stat.withColumnsRenamed({"size": "size_", "mtime": "mtime_"}), same, "left")
    return out.select(*manifest.columns, F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("devices", F.lit(1)).alias("devices"), "twins")


def hash_of(manifest: DataFrame, path: str | DataFrame) -> DataFrame:
    """The hash of one path, or of those that a small table (path) holds; no row for one that isn't known."""
    known = manifest.where("hash is not null")
    return (known.where(F.col("path") == path) if isinstance(path, str) else known.join(path.select("path").distinct(), "path", "left_semi")).select("hash")
