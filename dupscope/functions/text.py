"""Formatting and quoting expressions: pure columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of human-readable sizes.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def _one_decimal(x: Column, unit: str) -> Column:
    """A number with one decimal and its unit, null for null; what lies halfway goes to the even digit."""
    whole = F.floor(x).cast("double")
    tenths = F.rint((x - whole) * 10)  # a rounding of x as it is, not of the digits it is shown with
    return F.when(x.isNotNull(), F.format_string(f"%.1f {unit}", whole + tenths / 10))


def human_bytes(n: Column, largest: str = UNITS[-1]) -> Column:
    """largest: the unit of whatever is beyond it."""
    top = UNITS.index(largest)
    out = _one_decimal(n / float(1 << 10 * top), largest)
    for k in range(top - 1, 0, -1):
        out = F.when(n < (1 << 10 * (k + 1)), _one_decimal(n / float(1 << 10 * k), UNITS[k])).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    hours = F.floor(s / 3600)
    minutes = F.floor((s % 3600) / 60)
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%02ds", minutes, s % 60))
        .when(s.isNotNull(), F.format_string("%dh%02dm", hours, minutes))
    )


def speed(n: Column, seconds: Column) -> Column:
    return F.when((n <= 0) | (seconds <= 0), F.lit("—")).otherwise(_one_decimal(n / seconds / 1048576.0, "MiB/s"))


def age(created_at: Column, now: Column) -> Column:
    """Humanised age of a `YYYY-MM-DD HH:MM:SS` text at a given time."""
    then = F.try_to_timestamp(created_at, F.lit("yyyy-MM-dd HH:mm:ss"))
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(then), F.lit(0).cast("long"))
    return (
        F.when(then.isNull(), F.lit("unknown"))
        .when(s < 60, F.lit("just now"))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h ago")))
        .when(s < 7 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit(" d ago")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def short_date(epoch: Column) -> Column:
    """Years after 9999 have more digits, without the sign that Spark puts before them."""
    return F.ltrim(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd"), F.lit("+"))


def truncate_right(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, max(width - 1, 0)), F.lit("…")))


def truncate_left(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) <= width, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(max(width - 1, 0)))))


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def shell_label(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}']", "?")


def terminal(text: Column) -> Column:
    """Control characters as visible escapes."""
    out = text
    for code in [*range(32), *range(127, 160)]:
        seen = {9: "\\t", 10: "\\n", 13: "\\r"}.get(code, f"\\u{{{code:x}}}")
        out = F.replace(out, F.lit(chr(code)), F.lit(seen))
    return out


def csv_guard(text: Column) -> Column:
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cell(text: Column) -> Column:
    guarded = csv_guard(text)
    return F.when(guarded.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def pool(dataset: Column) -> Column:
    return F.substring_index(dataset, "/", 1)


def version_parts(text: Column) -> Column:
    """(major, minor, patch) of a leading X.Y[.Z]; null without one."""
    part = lambda k: F.regexp_extract(text, r"^\D*?(\d+)\.(\d+)(?:\.(\d+))?", k)
    return F.when(part(1) != "", F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), F.when(part(3) != "", part(3).cast("int")).otherwise(0).alias("patch")))


def reflink_gate(version: Column, cloning: Column) -> Column:
    """unsupported below 2.2.0; safe from 2.2.1 on with cloning enabled; else unsafe."""
    v = version_parts(version)
    at = lambda a, b, c: F.struct(F.lit(a).alias("major"), F.lit(b).alias("minor"), F.lit(c).alias("patch"))
    return F.when(v.isNull() | (v < at(2, 2, 0)), F.lit("unsupported")).when((v >= at(2, 2, 1)) & cloning, F.lit("safe")).otherwise(F.lit("unsafe"))


def layout(block: Column) -> Column:
    """The kind of the first line of a pool's status that names one: raidz3, raidz2, raidz1 or mirror; else stripe."""
    found = F.regexp_extract(block, r"(?m)^\s*(raidz3|raidz2|raidz|mirror)", 1)
    return F.when(found == "", "stripe").when(found == "raidz", "raidz1").otherwise(found)


def pool_layouts(status: Column) -> Column:
    """An array of (pool, layout), one for each ``pool:`` block of a status."""
    blocks = F.filter(F.split(status, r"(?m)^(?=[ \t]*pool:)"), lambda b: F.ltrim(b).startswith("pool:"))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"pool:[ \t]*(\S*)", 1).alias("pool"), layout(b).alias("layout")))


def base_device(device: Column) -> Column:
    """Block device without its partition suffix."""
    return F.when(device.rlike(r"(nvme|mmcblk)\d"), F.regexp_replace(device, r"p\d+$", "")).otherwise(F.regexp_replace(device, r"^((?:sd|vd|hd|xvd)[a-z]+)\d+$", "$1"))


def virtual_device(device: Column) -> Column:
    return device.rlike(r"^(loop|ram|zram|dm-|sr|md)")


def hex_encode(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_decode(digits: Column) -> Column:
    """The bytes; null for an odd length or a character that isn't a digit."""
    return F.when(digits.rlike(r"\A(?:[0-9a-fA-F]{2})*\z"), F.unhex(digits))
