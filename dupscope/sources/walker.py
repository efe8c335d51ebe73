"""Walking file systems: by rounds over rows of directories, or as a Python data source whose partitions are the roots' entries."""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import scratch

MANIFEST = "path string, size long, mtime long, mtime_nsec long, ctime_sec long, ctime_nsec long, device long, inode long"

#: Directories are opened for partitions up to so many levels, while there are fewer partitions than this.
LEVELS, PARTS = 4, 256


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], follow: bool):
        self.roots, self.follow = roots, follow

    def partitions(self) -> list[_Part]:
        """The roots' entries; directories are opened, level by level, while there are few."""
        out = list(self.roots)
        for _ in range(LEVELS):
            if len(out) >= PARTS:
                break
            opened = []
            for path in out:
                try:
                    opened += [e.path for e in os.scandir(path)] if os.path.isdir(path) and (self.follow or not os.path.islink(path)) else [path]
                except OSError:
                    continue
            out = opened
        return [_Part(path) for path in out] or [_Part("")]

    def _above(self, path: str) -> frozenset:
        """The directories above a path, which a followed link must not open again."""
        above = set()
        while self.follow and path != os.path.dirname(path):
            path = os.path.dirname(path)
            s = os.stat(path)
            above.add((s.st_dev, s.st_ino))
        return frozenset(above)

    def read(self, part: _Part) -> Iterator[tuple]:
        stack = [(part.path, self._above(part.path))] if part.path else []
        while stack:
            path, above = stack.pop()
            try:
                s = os.stat(path, follow_symlinks=self.follow)
                if stat.S_ISDIR(s.st_mode):
                    own = (s.st_dev, s.st_ino)
                    if own not in above:
                        below = above | {own} if self.follow else above
                        stack += [(e.path, below) for e in os.scandir(path)]
                elif stat.S_ISREG(s.st_mode):
                    path.encode("utf-8")
                    yield (path, s.st_size, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, s.st_ctime_ns // 10**9, s.st_ctime_ns % 10**9, s.st_dev, s.st_ino)
            except (OSError, UnicodeEncodeError):  # unreadable entries and names that aren't UTF-8 are passed over
                continue


class Walk(DataSource):
    """``spark.read.format("walk").option("roots", '["/a", "/b"]').load()``; symbolic links as ``followSymlinks`` says.

    roots is a JSON list, or paths without colons between colons.  A root may be a file.
    """

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return MANIFEST

    def reader(self, schema) -> _Reader:
        roots = self.options["roots"]
        return _Reader(json.loads(roots) if roots.startswith("[") else roots.split(":"), self.options.get("followSymlinks", "false") == "true")


def hashed(files: DataFrame) -> DataFrame:
    """files (path, size, device, inode and, if they are there, mtime, mtime_nsec, ctime_sec, ctime_nsec) with hash and error.

    The hash is the sha-256 of the content, if what was opened is what the row says, by all of these fields, and the path still leads to
    it unchanged after reading.
    """
    fields = {"size": "st_size", "device": "st_dev", "inode": "st_ino", "mtime": ("st_mtime_ns", "//"), "mtime_nsec": ("st_mtime_ns", "%"), "ctime_sec": ("st_ctime_ns", "//"), "ctime_nsec": ("st_ctime_ns", "%")}
    asked = [c for c in fields if c in files.columns]

    def told(s: os.stat_result, name: str) -> int:
        at = fields[name]
        if isinstance(at, str):
            return getattr(s, at)
        ns = getattr(s, at[0])
        return ns // 10**9 if at[1] == "//" else ns % 10**9

    def digest(row: dict) -> str:
        with open(row["path"], "rb") as f:
            before = os.fstat(f.fileno())
            for name in asked:
                if row[name] is not None and told(before, name) != row[name]:
                    raise OSError(f"changed since the walk: {name}")
            made = hashlib.file_digest(f, "sha256").hexdigest()
            after = os.fstat(f.fileno())
        if any(told(before, name) != told(after, name) for name in fields):
            raise OSError("changed while read")
        there = os.stat(row["path"])
        if (there.st_dev, there.st_ino) != (after.st_dev, after.st_ino):
            raise OSError("another file took its path")
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for row in batch.select(["path", *asked]).to_pylist():
                try:
                    out.append(digest(row))
                    errors.append(None)
                except OSError as e:
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, "hash", "error"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{own}, hash string, error string")


#: Blocks of a file that one task reads at a time.
RUN = 64


def file_blocks(size: int = 1 << 20):
    """Blocks of files, read by byte ranges (operators.groups.Blocks): a large file is many tasks' work, and no row holds more than a block.

    Files that can't be read, or are shorter than their row says, have no blocks from there on.  An empty file has one empty block.
    """

    def blocks(rows: DataFrame, low: int, high: int) -> DataFrame:
        names = rows.columns
        at, kind = names.index("path"), rows.schema
        count = F.greatest(F.ceil(F.col("size") / size), F.lit(1))
        runs = rows.where(count > low).withColumn("from_", F.explode(F.sequence(F.lit(low).cast("long"), F.least(count, F.lit(high)) - 1, F.lit(RUN).cast("long")))).withColumn("to_", F.least(count, F.lit(high), F.col("from_") + RUN))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low_, high_ = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
                for i, path in enumerate(batch.column(at).to_pylist()):
                    own = batch.slice(i, 1)
                    try:
                        with open(path, "rb") as f:
                            f.seek(low_[i] * size)
                            for block in range(low_[i], high_[i]):
                                data = f.read(size)
                                if not data and block:
                                    break
                                yield pa.RecordBatch.from_arrays([*own.columns[: len(names)], pa.array([block], pa.int64()), pa.array([data], pa.binary())], [*names, "block", "data"])
                    except OSError:
                        continue

        dealt = runs.repartition("path", "from_")
        return dealt.mapInArrow(run, StructType([*kind.fields, StructField("block", LongType()), StructField("data", BinaryType())]))

    return blocks


# -- walking by rounds ------------------------------------------------------------------------------

#: Entries that a task visits before it hands on the directories it hasn't opened.
BUDGET = 20_000
FOUND = f"kind string, {MANIFEST}, reason string, above array<string>"


def walk(spark: SparkSession, roots: list[str], follow: bool = False, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): the manifest below the roots, and path, reason of each entry passed over.

    Directories are rows.  In a round every task opens directories until it has visited so many entries and hands on the rest, which are
    dealt anew for the next round, so one deep or wide directory spreads over all tasks and an even tree is a few rounds.
    Reasons: name (not UTF-8; its path has the bytes escaped), unreadable, loop (a followed link to a directory above), kind (neither file nor directory).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[str]]] = []
        for batch in batches:
            stack += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        stack.reverse()
        rows: list[tuple] = []
        visited = 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 7, pa.string(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in FOUND.split(", ")])

        def other(kind: str, path: str, reason: str | None = None, above: list[str] | None = None) -> tuple:
            return (kind, path, *[None] * 7, reason, above)

        def entry(path: str, above: list[str]) -> None:
            try:
                path.encode("utf-8")
            except UnicodeEncodeError:
                rows.append(other("skipped", os.fsencode(path).decode("utf-8", "backslashreplace"), "name"))
                return
            try:
                s = os.stat(path, follow_symlinks=follow)
            except OSError:
                rows.append(other("skipped", path, "unreadable"))
                return
            if stat.S_ISDIR(s.st_mode):
                own = f"{s.st_dev}:{s.st_ino}"
                if own in above:
                    rows.append(other("skipped", path, "loop"))
                else:
                    stack.append((path, [*above, own] if follow else above))
            elif stat.S_ISREG(s.st_mode):
                rows.append(("file", path, s.st_size, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, s.st_ctime_ns // 10**9, s.st_ctime_ns % 10**9, s.st_dev, s.st_ino, None, None))
            elif not (stat.S_ISLNK(s.st_mode) and not follow):
                rows.append(other("skipped", path, "kind"))

        while stack and visited < budget:
            path, above = stack.pop()
            if above and above[0] == "root":  # a root is an entry itself
                entry(path, higher(path))
                visited += 1
                continue
            try:
                with os.scandir(path) as found:
                    for e in found:
                        entry(e.path, above)
                        visited += 1
                        if len(rows) >= 10_000:
                            yield made()
            except OSError:
                rows.append(other("skipped", path, "unreadable"))
        rows += [other("open", path, None, above) for path, above in stack]
        if rows:
            yield made()

    def higher(path: str) -> list[str]:
        """The directories above a root, which a followed link must not open again."""
        out = []
        while follow and path != os.path.dirname(path):
            path = os.path.dirname(path)
            try:
                s = os.stat(path)
            except OSError:
                continue
            out.append(f"{s.st_dev}:{s.st_ino}")
        return out

    frontier = spark.createDataFrame([(r, ["root"]) for r in roots], "path string, above array<string>")
    tables: list[DataFrame] = []
    while True:
        tables.append(scratch.cut(frontier.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, FOUND), "walk"))
        frontier = tables[-1].where("kind = 'open'").select("path", "above")
        if frontier.isEmpty():
            break
    every = spark.read.schema(tables[0].schema).parquet(*[f for t in tables for f in t.inputFiles()])
    return every.where("kind = 'file'").select(*[f.split()[0] for f in MANIFEST.split(", ")]), every.where("kind = 'skipped'").select("path", "reason")
