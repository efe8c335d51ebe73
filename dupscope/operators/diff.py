"""Two snapshots compared, as sets: by path, then device and inode and size, then hash; each row is used once.

Both snapshots are read once, by one full outer join on the path.  What it leaves on either side is written, and paired by the keys in turn: rows
are numbered by path within key and side, and the rows of one key and number are a pair.  Ties are so paired by path order, and the
result doesn't depend on storage order.  Paths are unique within a snapshot; rows without a key stay for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import scratch
from . import ranks

COLUMNS = ["path", "size", "mtime", "device", "inode", "hash"]
LEFT = ["is_new", "path", "size", "device", "inode", "hash"]


def _paired(left: DataFrame, key: list[str]) -> DataFrame:
    """old, new: the rows of a written table left over on both sides, paired by key; one of the two is null where none is left."""
    known = " and ".join(f"{k} is not null" for k in key)
    row = F.struct(*LEFT)
    numbered = ranks.within(left.where(known), [*key, "is_new"], "path", "n")
    pairs = numbered.groupBy(*key, "n").agg(F.max(F.when(~F.col("is_new"), row)).alias("old"), F.max(F.when(F.col("is_new"), row)).alias("new"))
    keyless = left.where(f"not ({known})").select(F.when(~F.col("is_new"), row).alias("old"), F.when(F.col("is_new"), row).alias("new"))
    return scratch.cut(pairs.select("old", "new").union(keyless), "paired")


def changes(old: DataFrame, new: DataFrame, root: str = "/") -> DataFrame:
    """kind, old_path, new_path: unchanged, modified, moved_inode, moved_hash, deleted, new, new_dup."""
    side = lambda rows: rows.select(*COLUMNS).where(paths.under_root(F.col("path"), root)).select("path", F.struct(*COLUMNS).alias("row"))
    o, n = side(old).withColumnRenamed("row", "o"), side(new).withColumnRenamed("row", "n")
    same = (F.col("o.size") == F.col("n.size")) & (F.col("o.mtime") == F.col("n.mtime"))
    kind = F.when(F.col("o").isNull() | F.col("n").isNull(), F.lit(None)).when(same, "unchanged").otherwise("modified")
    one = F.coalesce("n", "o")
    joined = scratch.cut(o.join(n, "path", "full").select(kind.alias("kind"), F.col("o").isNull().alias("is_new"), "path", *[one[c].alias(c) for c in LEFT[2:]], F.col("o.hash").alias("old_hash")), "joined")

    by_inode = _paired(joined.where("kind is null"), ["device", "inode", "size"])
    single = by_inode.where("old is null or new is null").select(F.explode(F.array_compact(F.array("old", "new"))).alias("r")).select("r.*")
    by_hash = _paired(single, ["hash"])
    known = joined.where("old_hash is not null").select(F.col("old_hash").alias("hash")).distinct().withColumn("known", F.lit(True))
    fresh = by_hash.where("old is null").select("new.path", "new.hash").join(known, "hash", "left")
    both, none = "old is not null and new is not null", F.lit(None).cast("string")
    return (
        joined.where("kind is not null").select("kind", F.col("path").alias("old_path"), F.col("path").alias("new_path"))
        .union(by_inode.where(both).select(F.lit("moved_inode"), "old.path", "new.path"))
        .union(by_hash.where(both).select(F.lit("moved_hash"), "old.path", "new.path"))
        .union(by_hash.where("new is null").select(F.lit("deleted"), "old.path", none))
        .union(fresh.select(F.when(F.col("known"), "new_dup").otherwise("new"), none, "path"))
    )


def peers(old: DataFrame, new: DataFrame, root: str = "/") -> DataFrame:
    """new_path, peers, first_peer: for newly duplicated files, how many old files have the content, and the first of them.

    The peers themselves are the old files of the hash; they are never paired with each new file.
    """
    dup = changes(old, new, root).where("kind = 'new_dup'").select(F.col("new_path").alias("path"))
    hashed = new.join(dup, "path", "left_semi").select(F.col("path").alias("new_path"), "hash")
    known = old.where(paths.under_root(F.col("path"), root)).groupBy("hash").agg(F.count(F.lit(1)).alias("peers"), F.min("path").alias("first_peer"))
    return hashed.join(known, "hash").select("new_path", "peers", "first_peer")
