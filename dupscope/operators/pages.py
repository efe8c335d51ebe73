"""Pages of the members of groups, read from a counted index.

The index is the members sorted by group and path, one folder of files for each range, with every row's place in its range, and
what each range begins with and holds.  A page is a run of places, so its ranges are known before anything is read, and no other
range is.  The ranges are as many as shuffle partitions.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: How a content hash is written; anything else names no group.
HASH = r"^[0-9a-f]{64}$"


@dataclass
class Pages:
    #: cell_, in_ and the members' columns: a written table with a folder for each range.
    table: DataFrame
    #: Each range's number, first (group, path), place of the first row and rows, in order: one for each range.
    cells: list[tuple[int, tuple, int, int]]
    group: str
    #: Each group's first place and number of members.
    groups: DataFrame


def index(members: DataFrame, group: str = "hash") -> Pages:
    """members: path and a column that names the group, neither null."""
    order = [F.asc(group), F.asc("path")]
    at = F.monotonically_increasing_id()
    rows = members.where(f"`{group}` is not null and path is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    table = scratch.cut(rows.withColumns({"cell_": F.shiftright(at, 33).cast("int"), "in_": at.bitwiseAND((1 << 33) - 1)}), "pages", by=("cell_",))
    found = table.groupBy("cell_").agg(F.min(F.struct(group, "path")).alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    cells, before = [], 0
    for r in sorted(found, key=lambda r: tuple(r["first"])):
        cells.append((r["cell_"], tuple(r["first"]), before, r["n"]))
        before += r["n"]
    starts = table.sparkSession.createDataFrame([(c, b) for c, _, b, _ in cells], "cell_ int, before_ long")
    own = table.join(F.broadcast(starts), "cell_").groupBy(group).agg(F.min(F.col("before_") + F.col("in_")).alias("first_"), F.count(F.lit(1)).alias("members"))
    return Pages(table, cells, group, scratch.cut(own.sortWithinPartitions(group), "groups"))


def _between(at: Pages, low: int, high: int) -> DataFrame:
    """The rows at places low to high - 1 of the whole order, from the ranges that hold them."""
    held = [(c, b) for c, _, b, n in at.cells if b < high and b + n > low]
    place = F.col("in_") + F.coalesce(*[F.when(F.col("cell_") == c, b) for c, b in held], F.lit(0))
    rows = at.table.where(F.col("cell_").isin([c for c, _ in held])).withColumn("place_", place)
    return rows.where((F.col("place_") >= low) & (F.col("place_") < high)).orderBy("place_").drop("cell_", "in_", "place_")


def page(at: Pages, group: object, offset: int, limit: int) -> DataFrame:
    """Members offset to offset + limit of a group, by path; none if there is no such group."""
    own = at.groups.where(F.col(at.group) == F.lit(group)).first()  # one row
    if own is None:
        return _between(at, 0, 0)
    return _between(at, own["first_"] + offset, own["first_"] + min(offset + limit, own["members"]))


def page_of_hash(at: Pages, text: str, offset: int = 0, limit: int = 1 << 31) -> DataFrame:
    """The same for a hash as a user wrote it, in either case of letters; what isn't one names no group."""
    import re

    return page(at, text.lower(), offset, limit) if re.match(HASH, text.lower()) else _between(at, 0, 0)


def after(at: Pages, group: object, path: str, limit: int) -> DataFrame:
    """The next members of a group after a path (itself there or not), read from the range it lies in and as many after it as the limit needs."""
    firsts = [f for _, f, _, _ in at.cells]
    begin = max(0, bisect_left(firsts, (group, path)) - 1)
    upto, n = begin + 1, 0
    while upto < len(at.cells) and n < limit and at.cells[upto][1][0] == group:
        n += at.cells[upto][3]
        upto += 1
    rows = at.table.where(F.col("cell_").isin([c for c, _, _, _ in at.cells[begin:upto]]))
    return rows.where((F.col(at.group) == F.lit(group)) & (F.col("path") > path)).orderBy("path").limit(limit).drop("cell_", "in_")


def numbered(at: Pages, limit: int) -> DataFrame:
    """All members with the number of their page in the group, from 0; no group is gathered."""
    starts = at.table.sparkSession.createDataFrame([(c, b) for c, _, b, _ in at.cells], "cell_ int, before_ long")
    rows = at.table.join(F.broadcast(starts), "cell_").join(at.groups.select(at.group, "first_"), at.group)
    return rows.withColumn("page", F.floor((F.col("before_") + F.col("in_") - F.col("first_")) / limit)).drop("cell_", "in_", "before_", "first_")
