"""Duplicate analytics on Spark: manifests, groups, signatures, diffs and plans as DataFrames."""
