"""Marks and the plans made from them: rows, legality, verification, totals, scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.rules import ACTIONS


def rows(manifest: DataFrame, marks: DataFrame) -> DataFrame:
    """kind, target, keeper, size, hash, devices: marked files with the first keeper of their hash, unless they are the same physical file."""
    marked = manifest.where("hash is not null").join(marks, "path")
    keep = marked.where("is_keeper").groupBy("hash").agg(F.min_by(F.struct("path", "device", "inode"), "path").alias("k"))
    targets = marked.where(~F.col("is_keeper") & F.col("action").isin(*ACTIONS))
    out = targets.join(keep, "hash").where((F.col("device") != F.col("k.device")) | (F.col("inode") != F.col("k.inode")))
    return out.select(F.col("action").alias("kind"), F.col("path").alias("target"), F.col("k.path").alias("keeper"), "size", "hash", F.col("device").alias("target_device"), F.col("k.device").alias("keeper_device"))


#: Fixed value: rows that a digest quotes.
SAMPLES = 5


def digest(plan: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("kind"))
    return plan.groupBy("kind").agg(F.count(F.lit(1)).alias("actions"), F.sum("size").alias("bytes")).withColumn("place", place)


def samples(plan: DataFrame) -> DataFrame:
    """place (from 1), kind, target of the first rows by target, and hidden: how many a digest leaves out."""
    first = plan.select("target", "kind").orderBy("target", "kind").limit(SAMPLES)
    hidden = plan.agg(F.greatest(F.count(F.lit(1)) - SAMPLES, F.lit(0)).alias("hidden"))  # one row
    placed = first.select(F.row_number().over(Window.orderBy("target", "kind")).alias("place"), "kind", "target")  # SAMPLES rows
    return placed.join(F.broadcast(hidden))


def verify_bytes(plan: DataFrame) -> DataFrame:
    """Bytes that checking the plan reads: everything twice, or each keeper once."""
    keepers = plan.groupBy("keeper").agg(F.max("size").alias("size")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("k"))
    own = plan.agg(F.coalesce(F.sum(2 * F.col("size")), F.lit(0)).alias("strict"), F.coalesce(F.sum("size"), F.lit(0)).alias("t"))
    return own.join(keepers).select("strict", (F.col("t") + F.col("k")).alias("once"))


def _first_datasets(datasets: DataFrame, *columns: str) -> DataFrame:
    """device_id and columns of the first dataset of each device: by place, where the listing says one, else by name."""
    order = F.struct("place", "name") if "place" in datasets.columns else F.col("name")
    first = F.min_by(F.struct(*columns), order).alias("d")
    return datasets.groupBy("device_id").agg(first).select("device_id", *[F.col(f"d.{c}").alias(c) for c in columns])


def legality(plan: DataFrame, datasets: DataFrame, reflink_safe: bool) -> DataFrame:
    """plan with reason, null where the action may run."""
    one = _first_datasets(datasets, "name")
    named = plan.join(one.select(F.col("device_id").alias("target_device"), F.col("name").alias("target_dataset")), "target_device", "left").join(one.select(F.col("device_id").alias("keeper_device"), F.col("name").alias("keeper_dataset")), "keeper_device", "left")
    kind = F.col("kind")
    reason = (
        F.when(F.col("target_dataset").isNull(), "dataset unknown")
        .when((kind == "hardlink") & (F.col("target_device") != F.col("keeper_device")), "other device")
        .when((kind == "reflink") & F.lit(not reflink_safe), "reflink not safe")
        .when((kind == "reflink") & (F.col("keeper_dataset").isNull() | (text.pool(F.col("target_dataset")) != text.pool(F.col("keeper_dataset")))), "other pool")
    )
    return named.withColumn("reason", reason)


def revalidated(plan: DataFrame, current: DataFrame, strict: bool = True) -> DataFrame:
    """plan with mismatch, what differs now at the target or keeper (null if nothing), and read, the bytes that finding it reads.

    current: path, size, hash and, if there, is_symlink.  Links and sizes are always looked at, then contents, the target's first; what fails ends a
    row's checks.  Strict: every row reads its keeper.  Else a keeper whose content was right for the first row that reads it isn't
    read for the others.
    """
    link = F.col("is_symlink") if "is_symlink" in current.columns else F.lit(False)
    at = lambda side: current.select(F.col("path").alias(side), F.col("size").alias(f"{side}_size"), F.col("hash").alias(f"{side}_hash"), F.coalesce(link, F.lit(False)).alias(f"{side}_link"))
    out = plan.join(at("target"), "target", "left").join(at("keeper"), "keeper", "left")
    found = F.lit(None).cast("string")
    for side in ("keeper", "target"):
        found = F.when(F.col(f"{side}_size").isNull(), f"{side} missing").when(F.col(f"{side}_link"), f"{side} link").when(F.col(f"{side}_size") != F.col("size"), f"{side} size").when(~F.col(f"{side}_hash").eqNullSafe(F.col("hash")), f"{side} content").otherwise(found)
    return _read(out.withColumn("mismatch", found), strict)


def _read(out: DataFrame, strict: bool) -> DataFrame:
    """out with read: each side's size where its content is read; not strict, a keeper of one identity is read by its first row only."""
    whole = lambda side: F.when(F.col(f"{side}_size").eqNullSafe(F.col("size")) & ~F.col(f"{side}_link"), F.col("size")).otherwise(F.lit(0))
    if strict:
        return out.withColumn("read", whole("target") + F.when(F.coalesce(F.col("mismatch").startswith("target"), F.lit(False)), F.lit(0)).otherwise(whole("keeper")))
    ready = F.when(F.coalesce(F.col("mismatch").startswith("target"), F.lit(False)), F.lit(None)).otherwise(F.col("target"))
    first = out.select("keeper", ready.alias("ready")).groupBy("keeper").agg(F.min("ready").alias("first_"))
    again = out.join(first, "keeper", "left")
    bad = F.coalesce(F.col("mismatch") == "keeper content", F.lit(False))  # what failed isn't taken as checked
    once = F.when(ready.isNotNull() & ((F.col("target") == F.col("first_")) | bad), whole("keeper")).otherwise(F.lit(0))
    return again.withColumn("read", whole("target") + once).drop("first_")


def outcome_totals(outcomes: DataFrame, cancelled: bool = False) -> DataFrame:
    """succeeded, failed, bytes_reclaimed, bytes_planned; of a batch that was cancelled, outcomes has the rows that were tried (ok) and those that weren't (ok null)."""
    ok = F.col("ok")
    out = outcomes.agg(F.count(F.when(ok, 1)).alias("succeeded"), F.count(F.when(~ok, 1)).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("bytes_reclaimed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_planned"))
    return out.withColumn("cancelled", F.lit(True)) if cancelled else out


def affected_datasets(plan: DataFrame, datasets: DataFrame) -> DataFrame:
    one = _first_datasets(datasets, "name").withColumnRenamed("device_id", "target_device")
    return plan.join(one, "target_device").groupBy("name").agg(F.min("target").alias("first_target"))


def quarantine_path(mountpoint, stamp, path):
    inside = paths.under_root(path, "/") & path.startswith(F.concat(mountpoint, F.lit("/")))
    rest = F.when(inside, F.substr(path, F.length(mountpoint) + 2)).otherwise(paths.name(path))
    return F.concat(mountpoint, F.lit("/.quarantine/"), stamp, F.lit("/"), rest)


def script_lines(plan: DataFrame, stamp: str, datasets: DataFrame) -> DataFrame:
    """target, line: the command of each row."""
    one = _first_datasets(datasets, "mountpoint").withColumnRenamed("device_id", "target_device")
    q = text.shell_quote
    t, k = F.col("target"), F.col("keeper")
    aside = quarantine_path(F.col("mountpoint"), F.lit(stamp), t)
    line = (
        F.when(F.col("mountpoint").isNull(), F.concat(F.lit("# skip: "), text.shell_label(t)))
        .when(F.col("kind") == "delete", F.concat(F.lit("mv -n -- "), q(t), F.lit(" "), q(aside)))
        .when(F.col("kind") == "hardlink", F.concat(F.lit("ln -f -- "), q(k), F.lit(" "), q(t)))
        .otherwise(F.concat(F.lit("cp --reflink=always -- "), q(k), F.lit(" "), q(t)))
    )
    return plan.join(one, "target_device", "left").select("target", line.alias("line"))


def script(plan: DataFrame, stamp: str, datasets: DataFrame, snapshot_tool: str | None = None) -> DataFrame:
    """section, target, step, line: a whole shell script, in the order of these columns.

    0: what begins every script.  1: a snapshot of each dataset that a target is on, by the tool's absolute path.  2: the actions by target, a
    comment, the checks and the command for each.  Where snapshots are needed and there is no tool, the script refuses and has no action.
    An empty plan says so.
    """
    spark = plan.sparkSession
    q = text.shell_quote
    rows = lambda section, lines: spark.createDataFrame([(section, "", i, x) for i, x in enumerate(lines)], "section int, target string, step int, line string")
    head = rows(0, ["#!/usr/bin/env bash", f"# Plan of {stamp}: files are moved to quarantine unchecked; links and copies are made if the size is still the same.", "set -euo pipefail"])
    size = plan.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()  # one row
    if not size["n"]:
        return head.union(rows(2, ["# The plan is empty."]))
    one = _first_datasets(datasets, "name", "mountpoint").select(F.col("device_id").alias("target_device"), F.struct("name", "mountpoint").alias("d"))
    placed = plan.join(one, "target_device", "left")
    named = placed.where("d is not null").groupBy("d.name").agg(F.min("target").alias("first"))
    if snapshot_tool is None and not named.isEmpty():
        return head.union(rows(1, ["# Refused: snapshots come first, and there is no trusted tool to make them.", "exit 1"]))
    snapshots = named.select(F.lit(1).alias("section"), F.col("first").alias("target"), F.lit(1).alias("step"), F.concat(F.lit(f"{snapshot_tool} snapshot "), q(F.concat("name", F.lit(f"@{stamp}")))).alias("line"))
    total = spark.createDataFrame([(2, "", 0, size["bytes"])], "section int, target string, step int, b long").select("section", "target", "step", F.concat(F.lit(f"# {size['n']} actions free about "), text.human_bytes(F.col("b")), F.lit(".")).alias("line"))
    t, k = F.col("target"), F.col("keeper")
    aside = quarantine_path(F.col("d.mountpoint"), F.lit(stamp), t)
    label = text.shell_label(t)
    same = F.concat(F.lit('[ "$(stat -c%s -- '), q(t), F.lit(')" = '), F.col("size").cast("string"), F.lit(' ] || { echo '), q(F.concat(F.lit("changed: "), label)), F.lit(" >&2; exit 1; }"))
    lost = F.col("d").isNull()
    lines = (
        F.when((F.col("kind") == "delete") & lost, F.array(F.concat(F.lit("# skip: "), label)))
        .when(F.col("kind") == "delete", F.array(F.concat(F.lit("# delete: "), label), F.concat(F.lit("mkdir -p -- "), q(paths.parent(aside))), F.concat(F.lit("mv -n -- "), q(t), F.lit(" "), q(aside))))
        .when(F.col("kind") == "hardlink", F.array(F.concat(F.lit("# hardlink: "), label), same, F.concat(F.lit("ln -f -- "), q(k), F.lit(" "), q(t))))
        .otherwise(F.array(F.concat(F.lit("# reflink: "), label), same, F.concat(F.lit("cp --reflink=always -- "), q(k), F.lit(" "), q(t))))
    )
    actions = placed.select(F.lit(2).alias("section"), "target", F.posexplode(lines).alias("at", "line")).select("section", "target", (F.col("at") + 1).alias("step"), "line")
    return head.union(rows(1, ["# Snapshots."])).union(snapshots).union(total).union(actions)


def save_marks(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Upsert by path; a row back at its default (no keeper, no action) is dropped."""
    new = changed.select("path", F.struct("is_keeper", "action").alias("new"))
    both = stored.select("path", F.struct("is_keeper", "action").alias("old")).join(new, "path", "full")
    kept = both.select("path", F.coalesce("new", "old").alias("m")).select("path", "m.is_keeper", "m.action")
    return kept.where("is_keeper or action is not null")


def _asked(rows: DataFrame, path: str | DataFrame) -> DataFrame:
    """rows with asked_: a path, or the one that a table of one row (path) holds, which is joined and not fetched; null if it holds none."""
    if isinstance(path, str):
        return rows.withColumn("asked_", F.lit(path))
    one = path.agg(F.max("path").alias("asked_"))  # one row
    return rows.join(F.broadcast(one))


def set_keeper(marks: DataFrame, group: DataFrame, path: str | DataFrame) -> DataFrame:
    """marks with path as the only keeper of its group (path of each file), its own action cleared; other groups stay."""
    one = group.select("path").distinct().withColumn("here", F.lit(True))
    both = _asked(marks.join(one, "path", "full"), path)
    chosen = F.col("path") == F.col("asked_")
    out = both.select("path", F.when(F.col("here"), chosen).otherwise(F.col("is_keeper")).alias("is_keeper"), F.when(~(F.coalesce("here", F.lit(False)) & chosen), F.col("action")).alias("action"))
    return out.where("is_keeper or action is not null")


def mark(marks: DataFrame, group: DataFrame, path: str | DataFrame, action: str | None) -> DataFrame:
    """marks with an action for path, a file of group (place, path).

    A keeper can't be marked: nothing changes.  An action where the group has no keeper makes its first other file the keeper.
    """
    now = group.select("place", "path").join(marks, "path", "left").select("place", "path", F.coalesce("is_keeper", F.lit(False)).alias("is_keeper"), "action")
    now = _asked(now, path)
    here = F.col("path") == F.col("asked_")
    state = now.agg(F.bool_or("is_keeper").alias("any"), F.bool_or(F.col("is_keeper") & here).alias("kept"), F.min_by(F.when(~here, F.col("path")), F.when(~here, F.col("place"))).alias("default"))
    free = ~F.col("kept")
    keeper = F.col("is_keeper") | (free & ~F.col("any") & F.lit(action is not None) & (F.col("path") == F.col("default")))
    new = now.join(F.broadcast(state)).select("path", keeper.alias("is_keeper"), F.when(here & free, F.lit(action)).otherwise(F.col("action")).alias("action"))
    rest = marks.join(group.select("path"), "path", "left_anti").select("path", "is_keeper", "action")
    return rest.union(new.where("is_keeper or action is not null"))


def from_groups(files: DataFrame) -> DataFrame:
    """Plan rows from files of groups (hash, place, path, size, device, inode, is_keeper, action); the first keeper by place counts."""
    keep = files.where("is_keeper").groupBy("hash").agg(F.min_by(F.struct("path", "device", "inode"), "place").alias("k"))
    targets = files.where(~F.col("is_keeper") & F.col("action").isin(*ACTIONS)).join(keep, "hash")
    other = (F.col("device") != F.col("k.device")) | (F.col("inode") != F.col("k.inode"))
    return targets.where(other).select(F.col("action").alias("kind"), F.col("path").alias("target"), F.col("k.path").alias("keeper"), "size", "hash", F.col("device").alias("target_device"), F.col("k.device").alias("keeper_device"))


def from_panels(marked: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan rows, one row no_hash) from files marked in panels (path, size, device, inode, is_keeper, action), grouped by the manifest's hash."""
    named = marked.join(manifest.select("path", "hash"), "path", "left")
    known = named.where("hash is not null").withColumn("place", F.col("path"))
    return from_groups(known), named.agg(F.count(F.when(F.col("hash").isNull(), 1)).alias("no_hash"))


def reconcile(marks: DataFrame, attempted: DataFrame, cancelled: bool) -> DataFrame:
    """After a batch: the attempted targets' marks go; after a finished one, all."""
    return marks.join(attempted.select(F.col("target").alias("path")), "path", "left_anti") if cancelled else marks.limit(0)
