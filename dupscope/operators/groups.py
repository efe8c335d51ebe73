"""Duplicate groups: summaries, members, keepers, verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import ranks


def sets(manifest: DataFrame) -> DataFrame:
    """hash, file_count, size, reclaim of each group."""
    g = manifest.where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("file_count"), F.min("size").alias("size")).where("file_count >= 2")
    return g.withColumn("reclaim", F.col("size") * (F.col("file_count") - 1))


def summaries(manifest: DataFrame) -> DataFrame:
    """rank (from 0), hash, file_count, size, reclaim; by reclaim, then hash."""
    return ranks.by_benefit(sets(manifest), "reclaim", "hash", 0).select("rank", "hash", "file_count", "size", "reclaim")


def member_counts(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """hash, members of the asked hashes, 0 for one that no file has."""
    own = manifest.join(asked.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count(F.lit(1)).alias("members"))
    return asked.select("hash").distinct().join(own, "hash", "left").withColumn("members", F.coalesce("members", F.lit(0)))


def members(manifest: DataFrame, groups: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    out = manifest.join(groups.select(*[c for c in ("rank", "hash", "file_count", "reclaim") if c in groups.columns]), "hash")
    if marks is not None:
        out = out.join(marks.select("path", "is_keeper", "action"), "path", "left").withColumn("is_keeper", F.coalesce("is_keeper", F.lit(False)))
    return out


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of rows that aren't indexed (operators.pages has the index)."""
    return rows.orderBy("path").offset(offset).limit(limit)


#: How a keeper is chosen among the members of a group: the largest of these.
KEEPERS = {
    "auto": lambda: F.struct("mtime", -F.octet_length("path"), "path"),
    "export": lambda: F.struct("mtime", "path"),
}


def keepers(members_: DataFrame, how: str) -> DataFrame:
    """One row of each group; combined before the shuffle, so that the copies of one content never meet in a task."""
    row = F.struct(*[F.col(c) for c in members_.columns])
    best = F.min_by(row, "path") if how == "first" else F.max_by(row, KEEPERS[how]())
    return members_.groupBy("hash").agg(best.alias("row")).select("row.*")


def auto_marks(members_: DataFrame) -> DataFrame:
    """path, is_keeper, action: the keeper of each group, everything else to delete."""
    keep = members_.select("path", "hash").join(keepers(members_, "auto").select("hash", F.col("path").alias("keeper")), "hash")
    is_keeper = F.col("path") == F.col("keeper")
    return keep.select("path", is_keeper.alias("is_keeper"), F.when(~is_keeper, "delete").alias("action"))


#: Bytes in a block; members whose blocks are compared with one copy of the reference's.
BLOCK, SPREAD = 1 << 20, 256

#: rows (path, size and more), first block, end -> a row for each block of those that is there: the rows' columns, block, data.
Blocks = Callable[[DataFrame, int, int], DataFrame]


def content_blocks(content: DataFrame, size: int = BLOCK) -> Blocks:
    """Blocks of contents (path, content) in a table; only the bytes of the blocks asked for leave it."""

    def blocks(rows: DataFrame, low: int, high: int) -> DataFrame:
        data = F.col("content").cast("binary")
        count = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1))
        own = content.withColumn("block", F.explode(F.when(count > low, F.sequence(F.lit(low).cast("long"), F.least(count, F.lit(high)) - 1))))
        return own.select("path", "block", F.substr(data, (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data")).join(rows, "path")

    return blocks


def verified(members_: DataFrame, content: DataFrame | Blocks, size: int = BLOCK) -> DataFrame:
    """Members equal, byte for byte, to the first of their group; groups of two or more, with file_count.

    content: a table (path, content), or blocks of files as from walker.file_blocks.  Members without content take no part.
    Blocks are compared by rounds of doubling length, and only members still equal go on, so most unequal ones cost one block.  A block
    moves once, to the reference's of the same number; a group of many members is dealt over tasks, each with a copy of the reference's block.
    """
    blocks = content if callable(content) else content_blocks(content, size)
    there = blocks(members_.select("path", "size", "hash"), 0, 1).select("path")
    found = members_.join(there, "path", "left_semi")
    of = found.groupBy("hash").agg(F.min("path").alias("first_"), F.min_by("size", "path").alias("bytes_"), F.count(F.lit(1)).alias("n_")).where("n_ >= 2")
    alive = scratch.cut(found.select("hash", "path", "size").join(of, "hash").where("size = bytes_").drop("bytes_"), "verify")
    last = -(-(alive.agg(F.max("size")).first()[0] or 0) // size) or 1  # one number
    low, high = 0, 1
    while low < last:
        high = min(high, last)
        count = F.greatest(F.ceil(F.col("size") / size), F.lit(1))
        here = alive.where(count > low)
        salts = F.ceil(F.col("n_") / SPREAD)
        one = blocks(here.where("path = first_"), low, high).select("hash", "block", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("data").alias("reference"))
        each = blocks(here.where("path <> first_"), low, high).withColumn("salt", F.pmod(F.xxhash64("path"), salts))
        same = each.join(one, ["hash", "block", "salt"]).where(F.col("data") == F.col("reference")).groupBy("path").agg(F.count(F.lit(1)).alias("same_"))
        whole = alive.join(same, "path", "left").where((F.col("path") == F.col("first_")) | (count <= low) | (F.col("same_") == F.least(count, F.lit(high)) - low)).drop("same_")
        left = whole.drop("n_").join(whole.groupBy("hash").agg(F.count(F.lit(1)).alias("n_")).where("n_ >= 2"), "hash")
        after = scratch.cut(left.select(*alive.columns), "verify")
        scratch.drop(alive)
        alive, low, high = after, high, 2 * high + 1
    return members_.join(alive.select("path", F.col("n_").alias("file_count")), "path").select(*members_.columns, "file_count")


def palette(members_: DataFrame) -> DataFrame:
    """hash, name, colour: distinct names of a group numbered by first appearance, modulo 5; none for a single name.

    Names are numbered without meeting in a task, however many a group has.
    """
    named = members_.withColumn("name", F.substring_index("path", "/", -1)).groupBy("hash", "name").agg(F.min("path").alias("seen"))
    many = named.groupBy("hash").agg(F.count(F.lit(1)).alias("n_")).where("n_ >= 2").select("hash")
    placed = ranks.within(scratch.cut(named.join(many, "hash", "left_semi"), "names"), ["hash"], "seen", "place_")
    return placed.select("hash", "name", ((F.col("place_") - 1) % 5).cast("long").alias("colour"))
