"""Configurations of scans as JSON, presets of extensions, and the listing of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import CONFIG

#: What a stored configuration without the field means.
DEFAULTS = {"reuse_hashes": False, "hash_profile": "Balanced", "dir_sig_algo": "old"}
#: The built-in presets; the first has no filter.
PRESETS = {
    "All": [],
    "Images": ["jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "heic", "heif", "svg", "ico", "raw", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2"],
    "Office documents": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "pdf", "rtf"],
}


def encoded(config: Column) -> Column:
    """A configuration (struct of the fields of CONFIG) as JSON; nulls are written."""
    return F.to_json(config, {"ignoreNullFields": "false"})


def decoded(json: Column) -> Column:
    """The configuration in a JSON text, with defaults for fields that older ones lack; null for broken JSON or one without roots."""
    raw = F.from_json(json, CONFIG)
    out = raw.withField("include_extensions", F.coalesce(raw["include_extensions"], F.array().cast("array<string>")))
    for name, value in DEFAULTS.items():
        out = out.withField(name, F.coalesce(raw[name], F.lit(value)))
    return F.when(raw["roots"].isNotNull(), out)


def presets(spark: SparkSession, user_json: DataFrame | None = None) -> DataFrame:
    """place, name, extensions: the built-in presets, then those of a user's file (value: its whole text); broken JSON counts as empty.

    Extensions are trimmed, without leading dots and lower-cased.
    """
    own = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(PRESETS.items())], "place int, name string, extensions array<string>")
    if user_json is not None:
        user = user_json.select(F.posexplode(F.from_json("value", "array<struct<name: string, extensions: array<string>>>")).alias("i", "p"))
        own = own.union(user.select(F.col("i") + len(PRESETS), "p.name", "p.extensions"))
    return own.withColumn("extensions", F.transform("extensions", lambda x: F.lower(F.ltrim(F.trim(x), F.lit(".")))))


def datasets(lines: DataFrame) -> DataFrame:
    """name, mountpoint of mounted file systems from tab-separated lines (value: name, mountpoint, mounted); malformed lines are passed over."""
    part = F.split("value", "\t", -1)
    named = lines.where(F.size(part) >= 3).select(part[0].alias("name"), part[1].alias("mountpoint"), part[2].alias("mounted"))
    return named.where(~F.col("mountpoint").isin("none", "legacy", "-") & (F.col("mounted") == "yes")).select("name", "mountpoint")
