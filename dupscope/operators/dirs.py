"""Directory signatures, twins and sizes.

Ancestors are exploded once and joined by equality, never by range.  A signature is a digest carried over the sorted entries of a
directory; entries are never gathered.  For twins, only one directory of each class is signed, which the root and most upper
directories are not in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import scratch
from . import folds, prefixes, ranks


def contained(manifest: DataFrame) -> DataFrame:
    """dir, path, size, hash: a row for each file and directory above it."""
    path = F.col("path")
    numbered = manifest.select("path", "size", "hash", F.explode(F.sequence(F.lit(1), paths.levels(path))).alias("n"))
    return numbered.select(paths.ancestor(path, F.col("n")).alias("dir"), "path", "size", "hash")


def sizes(manifest: DataFrame) -> DataFrame:
    return contained(manifest).groupBy("dir").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files")).where("bytes > 0")


def totals(manifest: DataFrame) -> DataFrame:
    """Complete directories: no file below lacks a hash."""
    return contained(manifest).groupBy("dir").agg(F.count(F.lit(1)).alias("file_count"), F.count("hash").alias("hashed"), F.sum("size").alias("size_per_dir")).where("file_count = hashed").drop("hashed")


def signatures(manifest: DataFrame, only_twins: bool = True) -> DataFrame:
    """dir, signature, file_count, size_per_dir from the sorted (relative path, hash) entries.

    For twins alone, classes are found by sums that combine before the shuffle (two 64-bit hashes of the entries, which are
    distinct within a directory), and one directory of each class is signed.
    """
    if not only_twins:
        return _signed(contained(manifest)).join(totals(manifest), "dir")
    entry = [paths.relative(F.col("path"), F.col("dir")), F.col("hash")]
    sums = [F.bit_xor(F.xxhash64(*entry)).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), *entry)).alias("y")]
    whole = contained(manifest).groupBy("dir").agg(F.count(F.lit(1)).alias("file_count"), F.count("hash").alias("hashed"), F.sum("size").alias("size_per_dir"), *sums).where("file_count = hashed")
    classes = whole.groupBy("file_count", "size_per_dir", "x", "y").agg(F.min("dir").alias("one"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    signed = _signed(contained(manifest).join(classes.select(F.col("one").alias("dir")), "dir", "left_semi")).withColumnRenamed("dir", "one")
    return whole.join(classes.join(signed, "one"), ["file_count", "size_per_dir", "x", "y"]).select("dir", "signature", "file_count", "size_per_dir")


def _signed(inside: DataFrame) -> DataFrame:
    """dir, signature: the digest of a directory's sorted (relative path, hash) entries, carried from row to row; none for incomplete ones."""
    rows = inside.select("dir", paths.relative(F.col("path"), F.col("dir")).alias("r"), F.col("hash").alias("h"))
    return folds.digests(rows, "dir", ["r", "h"], F.concat("r", F.lit("\0"), "h", F.lit("\0"))).where("digest is not null").withColumnRenamed("digest", "signature")


#: A table of levels: every directory with its depth (the root's is 0); sign is null where a file below has no hash.
LEVELS = ["dir", "sign", "files", "size", "depth"]


def _entries(manifest: DataFrame) -> DataFrame:
    """Files as entries (name, sign, files, size) of their directory (dir, depth)."""
    parent = paths.parent(F.col("path"))
    return manifest.select(parent.alias("dir"), paths.name(F.col("path")).alias("name"), F.col("hash").alias("sign"), F.lit(1).cast("long").alias("files"), "size", _depth(parent).alias("depth"))


def _depth(directory: Column) -> Column:
    return F.when(directory == "/", 0).otherwise(F.size(F.split(directory, "/")) - 1)


def _carried(level: DataFrame) -> DataFrame:
    """Directories of a level as entries of the directories above them."""
    return level.where("dir <> '/'").select(paths.parent(F.col("dir")).alias("dir"), paths.name(F.col("dir")).alias("name"), "sign", "files", "size")


def _level(entries: DataFrame, depth: int) -> DataFrame:
    """The written directories of one depth from their entries."""
    entry = F.concat("name", F.lit("\0"), "sign", F.lit("\0"))
    signed = folds.digests(entries.select("dir", "name", "sign"), "dir", ["name", "sign"], entry).withColumnRenamed("digest", "sign")
    sums = entries.groupBy("dir").agg(F.sum("files").alias("files"), F.sum("size").alias("size"))
    return scratch.cut(signed.join(sums, "dir").select("dir", "sign", "files", "size", F.lit(depth).alias("depth")), "level")


def _together(levels: list[DataFrame], spark: SparkSession) -> DataFrame:
    """The tables of levels as one scan."""
    if not levels:
        return spark.createDataFrame([], "dir string, sign string, files long, size long, depth int")
    return spark.read.schema(levels[0].schema).parquet(*[f for x in levels for f in x.inputFiles()])


def merkle_levels(manifest: DataFrame) -> DataFrame:
    """The table of levels, bottom-up: a directory's signature comes from its children's names and signatures.

    The files are written once, apart by depth; each level is a job of its own over its files and the written level below, so plans are
    as small for deep trees as for flat ones.
    """
    files = scratch.cut(_entries(manifest), "entries", by=("depth",))
    levels: list[DataFrame] = []
    for depth in range(files.agg(F.max("depth")).first()[0] or 0, -1, -1):  # one number
        here = files.where(F.col("depth") == depth).drop("depth")
        rows = here.unionByName(_carried(levels[-1])) if levels else here
        made = _level(rows, depth)
        if made.inputFiles():
            levels.append(made)
    return _together(levels, manifest.sparkSession)


def merkle_updated(levels: DataFrame, manifest: DataFrame, changed: DataFrame) -> DataFrame:
    """The table of levels after a change: only directories above the changed paths (added, removed or modified) are signed again.

    levels: the table before.  manifest: the files now.  A directory is signed from its direct children: its files, and its
    sub-directories as the level below has them, signed again or not.  Directories left without files go.
    """
    touched = scratch.cut(changed.select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).distinct().withColumn("depth", _depth(F.col("dir"))), "touched", by=("depth",))
    files = scratch.cut(_entries(manifest).join(touched, ["dir", "depth"], "left_semi"), "entries", by=("depth",))
    kept = levels.join(touched.select("dir"), "dir", "left_anti")
    again: list[DataFrame] = []
    for depth in range(touched.agg(F.max("depth")).first()[0] if not touched.isEmpty() else -1, -1, -1):  # one number
        own = touched.where(F.col("depth") == depth).select("dir")
        still = _carried(kept.where(F.col("depth") == depth + 1)).join(own, "dir", "left_semi")
        rows = files.where(F.col("depth") == depth).drop("depth").unionByName(still)
        made = _level(rows.unionByName(_carried(again[-1])) if again else rows, depth)
        again.append(made)
    return kept.select(*LEVELS).unionByName(_together([x for x in again if x.inputFiles()], levels.sparkSession).select(*LEVELS))


def complete(levels: DataFrame) -> DataFrame:
    """dir, signature, file_count, size_per_dir of the complete directories of a table of levels."""
    return levels.where("sign is not null").select("dir", F.col("sign").alias("signature"), F.col("files").alias("file_count"), F.col("size").alias("size_per_dir"))


def merkle(manifest: DataFrame) -> DataFrame:
    """The same classes bottom-up."""
    return complete(merkle_levels(manifest))


def twins(signed: DataFrame) -> DataFrame:
    """Rows of signatures that at least two directories have."""
    twice = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("dirs")).where("dirs >= 2")
    return signed.join(twice, "signature")


def group_summaries(signed: DataFrame) -> DataFrame:
    """rank (from 1), signature, dirs, file_count, size_per_dir, reclaim."""
    g = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("dirs"), F.min("file_count").alias("file_count"), F.min("size_per_dir").alias("size_per_dir")).where("dirs >= 2")
    g = g.withColumn("reclaim", F.col("size_per_dir") * (F.col("dirs") - 1))
    return ranks.by_benefit(g, "reclaim", "signature", 1)


def signatures_of(manifest: DataFrame, asked: DataFrame, algorithm: str = "old") -> DataFrame:
    """dir, signature of the asked directories (dir) by the scan's algorithm; empty and incomplete ones are absent."""
    if algorithm == "merkle":
        return merkle(manifest).join(asked.select("dir").distinct(), "dir", "left_semi").select("dir", "signature")
    below = contained(manifest).join(asked.select("dir").distinct(), "dir", "left_semi").select("path").distinct()
    signed = signatures(manifest.join(below, "path", "left_semi"), only_twins=False)
    return signed.join(asked.select("dir").distinct(), "dir", "left_semi").select("dir", "signature")


def resolved(manifest: DataFrame, group_rows: DataFrame, signed: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path, is_dir) with outcome and size: what a cursor there shows.

    file_group: the files of its group; dir_group: its twins; inner_dupes: the duplicates below it;
    else no_duplicates, or not_in_scan.
    """
    own = manifest.select("path", "hash").join(group_rows.select("hash", "file_count"), "hash", "left")
    twin = twins(signed).select(F.col("dir").alias("path"), "dirs")
    inside = contained(manifest).join(group_rows.select("hash"), "hash", "left_semi").groupBy(F.col("dir").alias("path")).agg(F.count(F.lit(1)).alias("inner"))
    out = covered(manifest, asked).join(own, "path", "left").join(twin, "path", "left").join(inside, "path", "left")
    outcome = (
        F.when(~F.col("is_dir") & F.col("hash").isNull(), "not_in_scan")
        .when(~F.col("is_dir") & F.col("file_count").isNotNull(), "file_group")
        .when(F.col("is_dir") & F.col("dirs").isNotNull(), "dir_group")
        .when(F.col("is_dir") & F.col("inner").isNotNull(), "inner_dupes")
        .when(F.col("covered"), "no_duplicates")
        .otherwise("not_in_scan")
    )
    size = F.when(F.col("is_dir"), F.coalesce("dirs", "inner")).otherwise(F.col("file_count"))
    return out.select("path", outcome.alias("outcome"), size.alias("size"))


def live_size(entries: DataFrame, root: str, depth: int = 64) -> DataFrame:
    """bytes of the files up to so many levels below root; entries: path, size, is_symlink.  Links are passed over."""
    level = F.size(F.split("path", "/")) - (1 if root == "/" else len(root.split("/")))
    return entries.where(paths.below(F.col("path"), root) & ~F.col("is_symlink") & (level <= depth)).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def groups(signed: DataFrame) -> DataFrame:
    """signature, paths (sorted), file_count, size_per_dir."""
    found = signed.groupBy("signature").agg(F.sort_array(F.collect_list("dir")).alias("paths"), F.min("file_count").alias("file_count"), F.min("size_per_dir").alias("size_per_dir"))
    return found.where(F.size("paths") >= 2)


def paths_of(signed: DataFrame, asked: DataFrame) -> DataFrame:
    """dir, signature of the directories that have one of the asked signatures, in order."""
    return signed.join(asked.select("signature").distinct(), "signature", "left_semi").select("dir", "signature").orderBy("signature", "dir")


def twins_of(signed: DataFrame, directory: str) -> DataFrame:
    own = signed.where(F.col("dir") == directory).select("signature")
    return twins(signed).join(own, "signature", "left_semi").select("dir", "signature")


def duplicates_inside(manifest: DataFrame, group_rows: DataFrame, directory: str) -> DataFrame:
    return manifest.where(paths.below(F.col("path"), directory)).join(group_rows.select("hash"), "hash", "left_semi")


def covered(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path) with whether it is a file of the manifest or has any below it."""
    return prefixes.covered(prefixes.index(manifest), asked)
