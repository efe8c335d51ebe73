"""Decision tables as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESUMABLE = ("walking", "hashing")
COMPLETED = ("complete", "complete_with_warnings")
STATUSES = (*RESUMABLE, *COMPLETED, "aborted")
ACTIONS = ("delete", "hardlink", "reflink")


def dedup_status(in_scan: Column, hash_: Column, copies: Column, devices: Column, twins: Column) -> Column:
    """copies: rows with the hash; devices: distinct devices of those; twins: rows with the size and mtime."""
    return (
        F.when(~in_scan, "not_in_scan")
        .when(hash_.isNull() & (twins >= 2), "likely_duplicate")
        .when(hash_.isNull(), "unhashed")
        .when((copies >= 2) & (devices > 1), "dangerous_dup")
        .when(copies >= 2, "verified_dup")
        .otherwise("hashed_unique")
    )


def compare_glyph(is_file: Column, there: Column, hash_a: Column, hash_b: Column, same_stat: Column) -> Column:
    return (
        F.when(~is_file, " ")
        .when(~there, "+")
        .when(hash_a.isNotNull() & hash_b.isNotNull(), F.when(hash_a == hash_b, "=").otherwise("~"))
        .when(same_stat, "≈")
        .otherwise("~")
    )


def completion(failures: Column) -> Column:
    return F.when(failures > 0, "complete_with_warnings").otherwise("complete")


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.call_function("div", done * 100, total))


def vacuum_due(hours: Column, since_hours: Column) -> Column:
    return (hours > 0) & (since_hours.isNull() | (since_hours >= hours))


def resume_choice(unfinished_at: Column, completed_at: Column) -> Column:
    return (
        F.when(unfinished_at.isNull() & completed_at.isNull(), "new_scan")
        .when(completed_at.isNull(), "resume")
        .when(unfinished_at.isNull(), "open_results")
        .when(unfinished_at > completed_at, "resume")
        .otherwise("open_results")
    )


def memory_estimate(hashed_files: Column) -> Column:
    """Fixed value: bytes that grouping a hashed file takes."""
    return hashed_files * 2560


#: Files on a page, and files shown of a group at most.
PAGE, SHOWN = 200, 50_000


def page_due(cursor: Column, loaded: Column, total: Column) -> Column:
    """Whether the next page is to be read: the cursor is within a page of the end of what is loaded."""
    return (loaded < F.least(total, F.lit(SHOWN))) & (cursor + PAGE >= loaded)


def reduced(values: Column) -> Column:
    """One word for a group's values: unknown, the value, or mixed.  An aggregate."""
    return F.when(F.count(values) == 0, "unknown").when(F.min(values) == F.max(values), F.min(values)).otherwise("mixed")
