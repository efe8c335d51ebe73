"""Sessions: lists, retention, coverage, resuming, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.rules import COMPLETED, RESUMABLE, STATUSES
from . import dirs, files, groups, ranks


def listed(scans: DataFrame, trashed: bool = False) -> DataFrame:
    return scans.where((F.coalesce("trashed", F.lit(False)) == trashed) & F.col("status").isin(*STATUSES))


def retention(scans: DataFrame, keep: int = 2, current: int | None = None) -> DataFrame:
    """scans not in the trash with to_trash: unfinished ones, and completed ones beyond the newest `keep` with the same roots.

    The current scan counts among the completed ones and is never trashed.
    """
    live = listed(scans)
    here = F.lit(False) if current is None else F.col("id") == current
    done = F.col("status").isin(*COMPLETED) | here
    newest = Window.partitionBy("roots").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return live.withColumn("place", F.sum(done.cast("long")).over(newest)).withColumn("to_trash", ~here & (~done | (F.col("place") > keep)))


def resume_probe(scans: DataFrame) -> DataFrame:
    """For each list of roots: newest unfinished and newest completed scan."""
    live = listed(scans)
    return live.groupBy("roots").agg(F.max(F.when(F.col("status").isin(*RESUMABLE), F.col("id"))).alias("unfinished"), F.max(F.when(F.col("status").isin(*COMPLETED), F.col("id"))).alias("completed"))


def coverage(scans: DataFrame, at: str) -> DataFrame:
    """Newest completed scan, in the trash or not, with a root at, above or below a directory."""
    one = scans.where(F.col("status").isin(*COMPLETED)).select("id", F.explode("roots").alias("root"))
    return one.where(paths.overlaps(F.col("root"), at)).agg(F.max("id").alias("scan_id"))


def newest(scans: DataFrame) -> DataFrame:
    return scans.agg(F.max("id").alias("newest"), F.max(F.when(F.col("status").isin(*STATUSES), F.col("id"))).alias("newest_known"))


def counts(scans: DataFrame, manifest: DataFrame) -> DataFrame:
    own = scans.agg(F.count(F.lit(1)).alias("scans"), F.count(F.when(F.col("trashed"), 1)).alias("trashed"))
    return own.join(manifest.agg(F.count(F.lit(1)).alias("files")))


# -- with the table of statistics -----------------------------------------------------------------

CANDIDATES = ("cand_files_total", "cand_files_hashed", "cand_bytes_total", "cand_bytes_hashed")


def with_statistics(scans: DataFrame, stats: DataFrame, trashed: bool = False) -> DataFrame:
    """Sessions in or out of the trash with their figures, 0 where a scan has no statistics; newest first."""
    figures = (*CANDIDATES, "files_scanned", "reclaimable_bytes")
    out = listed(scans, trashed).join(stats.select(F.col("scan_id").alias("id"), *figures), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in figures}).orderBy(F.desc("id"))


def with_progress(scans: DataFrame, stats: DataFrame, files: DataFrame, trashed: bool = False) -> DataFrame:
    """with_statistics, where scans that are hashing and have no figures of candidates get them from their files (scan_id, size, hash).

    Candidates are files whose size another file of the scan has; unknown sizes count as one.  Only the files of those scans are read.  All figures
    of a scan come from one place: bytes are null where no candidate's size is known.
    """
    out = with_statistics(scans, stats, trashed)
    old = out.where("status = 'hashing' and cand_bytes_total = 0").select("id")
    own = files.join(F.broadcast(old.withColumnRenamed("id", "scan_id")), "scan_id", "left_semi")  # a row for each session
    sizes = own.groupBy("scan_id", "size").agg(F.count(F.lit(1)).alias("n"), F.count("hash").alias("h")).where("n >= 2")
    found = sizes.groupBy(F.col("scan_id").alias("id")).agg(F.sum("n").alias("cand_files_total_"), F.sum("h").alias("cand_files_hashed_"), F.sum(F.col("n") * F.col("size")).alias("cand_bytes_total_"), F.sum(F.col("h") * F.col("size")).alias("cand_bytes_hashed_"))
    both = out.join(found, "id", "left")
    counted = F.col("cand_files_total_").isNotNull()
    return both.withColumns({c: F.when(counted, F.col(f"{c}_")).otherwise(F.col(c)) for c in CANDIDATES}).select(*out.columns).orderBy(F.desc("id"))


def report(scans: DataFrame, stats: DataFrame) -> DataFrame:
    """All scans that have statistics, in the trash or not, newest first."""
    return scans.join(stats.withColumnRenamed("scan_id", "id"), "id").orderBy(F.desc("id"))


def unprepared(scans: DataFrame, stats: DataFrame) -> DataFrame:
    """Completed scans out of the trash whose results are not marked as prepared."""
    marked = stats.select(F.col("scan_id").alias("id"), "results_materialized")
    out = scans.where((~F.coalesce("trashed", F.lit(False))) & F.col("status").isin(*COMPLETED)).join(marked, "id", "left")
    return out.where(~F.coalesce("results_materialized", F.lit(False)))


def preparation(scans: DataFrame, stats: DataFrame, recorded: DataFrame) -> DataFrame:
    """id, step of each unprepared scan: its groups were recorded or it is known to have none (mark), or they must be made (materialize).

    recorded: scan_id of each stored group.  A count of no groups says something only beside other results.
    """
    own = recorded.groupBy(F.col("scan_id").alias("id")).agg(F.count(F.lit(1)).alias("groups"))
    known = stats.select(F.col("scan_id").alias("id"), "groups_found", "files_scanned", "bytes_hashed")
    none = (F.col("groups_found") == 0) & ((F.col("files_scanned") > 0) | (F.col("bytes_hashed") > 0))
    out = unprepared(scans, stats).select("id").join(own, "id", "left").join(known, "id", "left")
    return out.select("id", F.when(F.col("groups").isNotNull() | F.coalesce(none, F.lit(False)), "mark").otherwise("materialize").alias("step"))


def begun(scans: DataFrame, config_json: str, now: str) -> DataFrame:
    """The row of a new scan: the next id, walking."""
    return scans.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit("walking").alias("status"), F.lit(config_json).alias("config_json"), F.lit(False).alias("trashed"))


def begun_statistics(begun_: DataFrame, stats: DataFrame) -> DataFrame:
    """The empty row of statistics that comes with a new scan; stats: the table it is for."""
    return updated(stats.where(F.lit(False)), begun_.select(F.col("id").alias("scan_id")))


def totals(manifest: DataFrame) -> DataFrame:
    """files, groups, reclaim, bytes_hashed, failures of a scan: one row."""
    seen = files.candidate_stats(manifest).select("bytes_hashed", (F.col("files_total") - F.col("files_hashed")).alias("failures"))
    found = groups.sets(manifest).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("reclaim"), F.lit(0)).alias("reclaim"))
    return manifest.agg(F.count(F.lit(1)).alias("files")).join(found).join(seen)  # one row each


def materialized(store, scan_id: int, algorithm: str = "old") -> None:
    """The results of a scan take the place of those stored: its groups, its twin directories, and its statistics, which say so.

    Each table is one commit; the statistics come last, so a scan that says its results are there has them.
    """
    here = store.read("file").where(F.col("scan_id") == scan_id)
    own = F.lit(scan_id).cast("long")
    found = groups.summaries(here).withColumn("scan_id", own)
    store.replace("file_group", found, scan_id)
    signed = dirs.merkle(here) if algorithm == "merkle" else dirs.signatures(here)
    store.replace("dir_dedup", dirs.twins(signed).select(own.alias("scan_id"), "signature", F.col("dir").alias("path"), "file_count", "size_per_dir"), scan_id)
    stats = store.read("scan_stats").where(F.col("scan_id") == scan_id)
    t = totals(here)
    changes = t.select(own.alias("scan_id"), F.col("groups").alias("groups_found"), F.col("reclaim").alias("reclaimable_bytes"), F.col("failures").alias("hash_failures"), F.lit(True).alias("results_materialized"))
    store.replace("scan_stats", updated(stats, changes), scan_id)


def record_moves(store, moves: DataFrame) -> None:
    """moves (created_at, scan_id, source_path, target_path, hash, duplicate) at the end of the journal, numbered on in the order of their sources."""
    last = store.read("move_event").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one number
    store.append("move_event", ranks.numbered(moves, [F.asc("source_path"), F.asc("target_path")], "id", last + 1))


def with_status(scans: DataFrame, scan_id: int, status: str, now: str) -> DataFrame:
    here = F.col("id") == scan_id
    return scans.withColumns({"status": F.when(here, status).otherwise(F.col("status")), "updated_at": F.when(here, now).otherwise(F.col("updated_at"))})


def created_at(scans: DataFrame, scan_id: int) -> DataFrame:
    return scans.where(F.col("id") == scan_id).select("created_at")


def with_trash(scans: DataFrame, scan_ids: DataFrame, trashed: bool) -> DataFrame:
    """scans with the flag of some (id) set or lifted."""
    some = scan_ids.select("id").distinct().withColumn("here", F.lit(True))
    return scans.join(some, "id", "left").withColumn("trashed", F.when(F.col("here"), F.lit(trashed)).otherwise(F.coalesce("trashed", F.lit(False)))).drop("here").select(*scans.columns)


def updated(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """stats with changes (scan_id and some of its columns) written over; elapsed_seconds is added.  Missing rows are made."""
    new = changes.withColumnsRenamed({c: f"new_{c}" for c in changes.columns if c != "scan_id"})
    both = stats.join(new, "scan_id", "full")
    cols = {}
    for f in stats.schema.fields:
        zero = F.lit(0).cast(f.dataType) if f.dataType.typeName() in ("long", "double", "integer") else F.lit(False) if f.dataType.typeName() == "boolean" else F.lit(None).cast(f.dataType)
        old = F.coalesce(f.name, zero)
        if f.name == "scan_id" or f.name not in changes.columns:
            cols[f.name] = F.col(f.name) if f.name == "scan_id" else old
        elif f.name == "elapsed_seconds":
            cols[f.name] = old + F.coalesce(f"new_{f.name}", F.lit(0.0))
        else:
            cols[f.name] = F.coalesce(f"new_{f.name}", old)
    return both.select(*[c.alias(n) for n, c in cols.items()])


def summary(stats: DataFrame, scan_id: int) -> DataFrame:
    return stats.where(F.col("scan_id") == scan_id).select("files_scanned", "bytes_hashed", "groups_found", "reclaimable_bytes", "hash_failures")


def compacted(store) -> tuple[list[int], int, int]:
    """Scans in the trash are purged and the tables rewritten; ids purged, files before and after."""
    ids = sorted(r["id"] for r in store.read("scan").where("trashed").select("id").collect())  # a number for each session
    store.purge(ids)
    done = [store.compact(name) for name in ("scan", "file", "scan_stats", "file_mark", "file_group", "dir_dedup", "move_event")]
    return ids, sum(b for b, _ in done), sum(a for _, a in done)
