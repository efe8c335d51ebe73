"""Line dedup by overlapping three-line windows.

A text's lines are its ``\\n``-separated parts; lines without a word are passed over (they are
kept and never counted in a window).  Three lines in a row make a window, known by a 128-bit
hash.  Windows found more than once in the corpus are repeated; the first occurrence (smallest
doc_id, then position) stays, and the lines covered by any later occurrence go, merged over
overlapping windows.  So each line that goes has an earlier copy that stays.  Texts that
share a doc_id, or have none, are told apart by a 128-bit hash, and ordered by it.

Texts with fewer than three such lines have no window and stay as they are.  Null text stays
null.  Rows with the same doc_id and text are one text here: both stay or lose the same lines.
Only hashes and positions are shuffled to find repeats; a window that a third of the rows
share is counted before the shuffle and met in a plain equi-join, which AQE can split.
Other columns keep their names and values, whatever they are called, but n_lines_ and n_removed_, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

WIDTH = 3


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _worded(lines: Column) -> Column:
    """Positions of the lines that have a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0, i)), lambda i: i.isNotNull())


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, t1, t2 (hash of the text), at (number among the lines with a word), k1, k2."""

    def of(lines: Column) -> Column:
        def keyed(at: Column) -> Column:
            starts = F.when(F.size(at) >= width, F.sequence(F.lit(0), F.size(at) - width)).otherwise(F.array().cast("array<int>"))

            def key(i: Column) -> Column:
                parts = [F.get(lines, F.get(at, i + k)) for k in range(width)]
                return F.struct(i.alias("at"), F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *parts).alias("k2"))

            return F.transform(starts, key)

        return let(_worded(lines), keyed)

    t1, t2 = _hashes(F.col("text"))
    # Hashes and windows are made once for each text, before the rows of its windows, which would each carry the text.
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), let(_lines(F.col("text")), of).alias("w"))
    return hashed.select("doc_id", "t1", "t2", F.explode("w").alias("w")).select("doc_id", "t1", "t2", "w.*")


def covered(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, t1, t2, gone: numbers (among the lines with a word) of the lines that go, for texts that lose any."""
    all_windows = scratch.cut(windows(docs.where("text is not null"), width), "windows")
    first = all_windows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t1", "t2", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = all_windows.join(first, ["k1", "k2"]).where(~F.struct("doc_id", "t1", "t2", "at").eqNullSafe(F.col("first")))
    lines = F.flatten(F.transform(F.collect_set("at"), lambda i: F.sequence(i, i + (width - 1))))
    return later.groupBy("doc_id", "t1", "t2").agg(F.array_distinct(lines).alias("gone"))


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same rows with the lines gone from text, and n_lines_ and n_removed_ added."""
    gone = covered(docs, width)
    t1, t2 = _hashes(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), t1.alias("h1"), t2.alias("h2"))
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")), "left")

    def rest(lines: Column) -> Column:
        def without(at: Column) -> Column:
            stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(F.col("gone"), lambda n: F.get(at, n)))
            return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

        return let(_worded(lines), without)

    text = F.col("row.text")
    new = F.when(F.col("gone").isNull(), text).otherwise(let(_lines(text), rest)).alias("text")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines_")
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_")
    kept = [c for c in docs.columns if c not in ("n_lines_", "n_removed_")]
    return both.select(*[new if c == "text" else F.col("row").getField(c).alias(c) for c in kept], n_lines, n_removed)


#: DuckDB SQL for the same rows: doc_id, n_lines, n_removed, text of documents.
SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs} WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM l
  WHERE length(translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0),
win AS (
  SELECT doc_id, i, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY a, b, c) AS n, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS r FROM win WHERE c IS NOT NULL),
later AS (SELECT DISTINCT doc_id, i + k AS i FROM ranked, range(3) t(k) WHERE n > 1 AND r > 1),
gone AS (SELECT w.doc_id, w.pos FROM worded w JOIN later USING (doc_id, i)),
made AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, m.text AS text FROM {docs} d LEFT JOIN made m USING (doc_id)
"""
