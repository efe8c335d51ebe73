"""Manifests, trees, snapshots, marks, datasets and sessions derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unblanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document, all hashed."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/"), d.cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        (d % 97 + 1700000000).alias("mtime"),
        (d % 3).alias("device"),
        d.alias("inode"),
        F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, hashed only where a size occurs twice."""
    every = unblanked(spark, sf_dir)
    twice = every.groupBy("size").agg(F.count(F.lit(1)).alias("same")).where("same >= 2")
    return every.join(twice, "size", "left").select("path", "size", "mtime", "device", "inode", F.when(F.col("same").isNotNull(), F.col("hash")).alias("hash"))


def tree(spark: SparkSession, sf_dir: str, incomplete: bool = False) -> DataFrame:
    """A directory for each conversation, a file for each turn."""
    c, t = F.col("conv_id"), F.col("turn")
    digest = F.sha2(F.col("role").cast("binary"), 256)
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("/conv/"), (c % 10).cast("string"), F.lit("/"), c.cast("string"), F.lit("/"), t.cast("string")).alias("path"),
        F.octet_length("role").cast("long").alias("size"),
        (F.when(~((c % 7 == 0) & (t == 0)), digest) if incomplete else digest).alias("hash"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = unblanked(spark, sf_dir).select("path", "size", "inode", "hash")
    i = F.col("inode")
    kind = i % 10
    old = base.where(kind != 3).select("path", "size", F.lit(1000).cast("long").alias("mtime"), F.lit(1).cast("long").alias("device"), "inode", "hash", (i % 5 != 0).cast("int").alias("identity_version"))
    moved = F.when(kind == 0, F.concat("path", F.lit(".mv"))).when(kind == 1, F.concat(F.lit("/corpus/moved/"), i.cast("string"))).otherwise(F.col("path"))
    new = base.where(kind != 4).select(
        moved.alias("path"),
        "size",
        F.when(kind == 2, 2000).otherwise(1000).cast("long").alias("mtime"),
        F.when(kind == 1, 2).otherwise(1).cast("long").alias("device"),
        F.when(kind == 1, i + 1000000).otherwise(i).alias("inode"),
        "hash",
    )
    return old, new


def marks(manifest_: DataFrame, groups: DataFrame) -> DataFrame:
    """path, is_keeper, action: a keeper in most groups, the other members by inode."""
    one = manifest_.groupBy("hash").agg(F.min("path").alias("one"))
    m = manifest_.join(groups.select("hash", "rank"), "hash").join(one, "hash").withColumn("first", F.col("path") == F.col("one"))
    keeper = F.col("first") & (F.col("rank") % 4 != 3)
    action = F.when(F.col("first"), None).when(F.col("inode") % 4 == 0, "delete").when(F.col("inode") % 4 == 1, "hardlink").when(F.col("inode") % 4 == 2, "reflink")
    return m.select("path", keeper.alias("is_keeper"), action.alias("action")).where("is_keeper or action is not null")


def datasets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("pool0/d0", "/corpus", 0, True), ("pool0/d1", "/corpus", 1, False), ("pool1/d2", "/corpus", 2, True)], "name string, mountpoint string, device_id long, snapdir_visible boolean")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan for each user of events: id, created_at, status, roots, trashed and its figures.

    bytes is the floor of a sum of doubles, and a sum near a whole number falls on either side of it, by the order of its terms.  They are added
    by event_id, which is the order of the table, however its rows are dealt.
    """
    u = F.col("user_id")
    every = Window.partitionBy("user_id").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = table(spark, sf_dir, "events").select("user_id", "ts", F.sum("value").over(every).alias("total"))
    own = summed.groupBy("user_id").agg(F.count(F.lit(1)).alias("files"), F.floor(F.max("total")).cast("long").alias("bytes"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    status = F.element_at(F.array(*map(F.lit, ("walking", "hashing", "complete", "complete_with_warnings", "aborted"))), (u % 5 + 1).cast("int"))
    root = F.element_at(F.array(*map(F.lit, ("/corpus", "/conv", "/corpus/en"))), (u % 3 + 1).cast("int"))
    return own.select(u.alias("id"), "created_at", status.alias("status"), F.array(root).alias("roots"), (u % 7 == 0).alias("trashed"), "files", "bytes")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of most of the sessions."""
    i, f, b = F.col("id"), F.col("files"), F.col("bytes")
    some = lambda c: F.when(i % 3 == 0, F.lit(0)).otherwise(c)
    return sessions(spark, sf_dir).where(i % 11 != 0).select(
        i.alias("scan_id"),
        f.alias("cand_files_total"),
        F.expr("files div 2").alias("cand_files_hashed"),
        b.alias("cand_bytes_total"),
        F.expr("bytes div 2").alias("cand_bytes_hashed"),
        some(f).alias("files_scanned"),
        some(b).alias("bytes_hashed"),
        (i % 2).alias("groups_found"),
        F.expr("bytes div 3").alias("reclaimable_bytes"),
        (i % 4 == 0).alias("results_materialized"),
    )

def changed_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The incomplete tree, the tree after some turns went and others were rewritten, and the changed paths."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    before = tree(spark, sf_dir, incomplete=True)
    c, t = F.col("conv_id"), F.col("turn")
    path = F.concat(F.lit("/conv/"), (c % 10).cast("string"), F.lit("/"), c.cast("string"), F.lit("/"), t.cast("string"))
    own = rows.select(path.alias("path"), ((c % 4 == 0) & (t == 1)).alias("gone"), ((c % 6 == 1) & (t == 0)).alias("new"))
    both = before.join(own, "path")
    after = both.where("not gone").select("path", "size", F.when(F.col("new"), "rewritten").otherwise(F.col("hash")).alias("hash"))
    return before, after, own.where("gone or new").select("path")


def histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(verified rows of two scans with whole identities, a new scan without hashes); the older scan has other hashes."""
    old, new = snapshots(spark, sf_dir)
    i = F.col("inode") % 1000000
    whole = lambda rows: rows.withColumns({"mtime_nsec": i * 7 % 1000, "ctime_sec": F.col("mtime") + i % 3, "ctime_nsec": i % 11})
    first = whole(old).withColumns({"scan_id": F.lit(1).cast("long"), "hash": F.concat(F.lit("stale"), "hash"), "identity_version": F.lit(1)})
    second = whole(old).withColumn("scan_id", F.lit(2).cast("long")).where(i % 9 != 0)
    target = whole(new).withColumn("ctime_nsec", F.when(i % 13 == 0, F.lit(99).cast("long")).otherwise(F.col("ctime_nsec")))
    return first.unionByName(second), target


def merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two directories /m/a and /m/b whose files mostly share names: a file for each document, paired by number, and some names that are taken besides."""
    d = F.col("doc_id")
    k = F.floor(d / 2)
    docs = table(spark, sf_dir, "documents")
    digest = F.when(k % 3 == 0, F.sha2(k.cast("string").cast("binary"), 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    size = F.when(k % 3 == 0, k).otherwise(F.octet_length("text").cast("long"))
    place = F.concat(F.lit("/"), (k % 7).cast("string"), F.lit("/"), k.cast("string"), F.lit(".txt"))
    rows = docs.where((d % 2 == 0) | (k % 5 != 0)).select(F.concat(F.when(d % 2 == 0, "/m/a").otherwise("/m/b"), place).alias("path"), size.alias("size"), digest.alias("hash"))
    taken = docs.where((d % 2 == 1) & (k % 11 == 0)).select(F.concat(F.lit("/m/b"), place, F.lit(".1")).alias("path"), F.lit(0).cast("long").alias("size"), F.lit("x").alias("hash"))
    return rows.union(taken)
