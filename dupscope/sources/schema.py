"""Schemas of the stored tables.  Never inferred; columns are only ever added."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = 2


def _s(*cols: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t) for n, t in cols])


L, S, B, I, D = LongType(), StringType(), BooleanType(), IntegerType(), DoubleType()

SCAN = _s(("id", L), ("created_at", S), ("updated_at", S), ("status", S), ("config_json", S), ("trashed", B))
FILE = _s(("scan_id", L), ("path", S), ("size", L), ("mtime", L), ("mtime_nsec", L), ("ctime_sec", L), ("ctime_nsec", L), ("identity_version", I), ("device", L), ("inode", L), ("hash", S))
SCAN_STATS = _s(("scan_id", L), ("elapsed_seconds", D), ("storage_type", S), ("pool_layout", S), ("zfs_version", S), ("files_scanned", L), ("bytes_hashed", L), ("groups_found", L), ("reclaimable_bytes", L), ("cand_files_total", L), ("cand_bytes_total", L), ("cand_files_hashed", L), ("cand_bytes_hashed", L), ("hash_failures", L), ("results_materialized", B))
FILE_MARK = _s(("scan_id", L), ("path", S), ("is_keeper", B), ("action", S))
FILE_GROUP = _s(("scan_id", L), ("rank", L), ("hash", S), ("file_count", L), ("size", L), ("reclaim", L))
DIR_DEDUP = _s(("scan_id", L), ("signature", S), ("path", S), ("file_count", L), ("size_per_dir", L))
MOVE_EVENT = _s(("id", L), ("created_at", S), ("scan_id", L), ("source_path", S), ("target_path", S), ("hash", S), ("duplicate", B))
DATASET = _s(("name", S), ("mountpoint", S), ("device_id", L), ("snapdir_visible", B))
CONFIG = "roots array<string>, exclude_globs array<string>, min_size long, max_size long, follow_symlinks boolean, include_extensions array<string>, storage_type_override string, reuse_hashes boolean, hash_profile string, dir_sig_algo string"
TABLES = {"scan": SCAN, "file": FILE, "scan_stats": SCAN_STATS, "file_mark": FILE_MARK, "file_group": FILE_GROUP, "dir_dedup": DIR_DEDUP, "move_event": MOVE_EVENT, "dataset": DATASET}
