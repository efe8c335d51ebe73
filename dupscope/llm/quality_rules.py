"""Quality rules with risk-controlled cutoffs.

Base figures of a text, over words ``[^\\x20\\x09-\\x0D]+``: words, code points in words, symbols,
lines equal to an earlier one, words in repeated 8-word windows.  Two fixed rules reject
(``base_failed``).  The other rules compare a ratio with a cutoff.

Method: risk control.  Labelled rows that passed the fixed rules are the holdout.  In each
stratum (lang; null is one) the rules' cutoffs are tightened together, one level at a time, and at each level the
good rows that any rule would reject are counted.  The exact (Clopper-Pearson) upper bound of their share is held
against ``ALPHA`` at level ``DELTA / strata``.  Levels are tested in a fixed order, loosest first, up to the first that
doesn't hold, so that only the strata need a correction (Bonferroni): the first level that is truly too strict passes with
probability ``DELTA / strata`` at most.  The strictest level before it is used; where none holds (too few labels) the rules
reject nothing in that stratum.  With probability 1 - DELTA no stratum loses more than ALPHA of its good rows.

All of it is DataFrame operations.  A stratum needs at least log(DELTA) / log(1 - ALPHA) = 149 labelled rows, so the rows of
counts that the driver sees are at most one for so many labels.  The cutoffs join the documents as a table.
Repeated rows each get a row.  Columns other than doc_id and lang are not returned.
Null and empty texts have zero figures and fail the first fixed rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .line_dedup import let

ALPHA, DELTA = 0.02, 0.05
WINDOW = 8
#: Strata up to which the cutoffs are broadcast.
STRATA = 10_000
#: rule -> candidate cutoffs, strictest first; rows above the cutoff are rejected.
CUTOFFS = {
    "symbols": (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0),
    "capitals": (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "doubled_lines": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "long_words": (9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 30.0),
}
SPACES = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ"


def _repeated(words: Column) -> Column:
    """Words in windows found at least twice: windows' hashes sorted, equal neighbours' places merged."""

    def in_windows(h: Column) -> Column:
        def counted(keys: Column) -> Column:
            def merged(s: Column) -> Column:
                places = F.filter(
                    F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"]), x["i"])),
                    lambda x: x.isNotNull(),
                )
                start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
                total = F.aggregate(F.sort_array(places), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))
                return total["n"].cast("long")

            return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), merged))

        return let(F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))), counted)

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), in_windows))


def figures(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = lambda x: F.length(F.translate(x, SPACES, "")) > 0
    lines = let(F.filter(F.split(text, "\n", -1), worded), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    of_words = let(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda w: w != ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("repeat")))
    out = docs.select(
        *[F.col(c) for c in docs.columns if c != "text"],
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long").alias("n_capitals"),
        lines.alias("lines_"),
        of_words.alias("words_"),
    )
    return out.select(*[c for c in out.columns if c not in ("lines_", "words_")], F.col("words_.n").alias("n_words"), F.col("words_.repeat").alias("n_repeat_words"), F.col("lines_.n").alias("n_lines"), F.col("lines_.dup").alias("n_dup_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "doubled_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "long_words": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    }


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a share: the p at which k or fewer of n have probability level."""
    if n == 0 or k >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    lo, hi = k / n, 1.0 - 1e-15
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid <= 0 or tail(mid) > level else (lo, mid)
    return hi


LEVELS = 8


def cutoffs(figured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """stratum -> rule -> certified cutoff, for strata where a level holds."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    rule = ratios()
    held = figured.where(~base_failed()).select("doc_id", "lang", *[c.alias(r) for r, c in rule.items()]).join(good, "doc_id", "left_semi")
    over = [" or ".join(f"{r} > {CUTOFFS[r][i]!r}D" for r in rule) for i in range(LEVELS)]
    counts = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.expr(x), 1)).alias(f"k{i}") for i, x in enumerate(over)])
    strata = max(1, counts.count())
    enough = math.ceil(math.log(delta / strata) / math.log1p(-alpha))
    return {row["lang"]: {r: CUTOFFS[r][i] for r in rule} for row in counts.where(F.col("n") >= enough).collect() for i in [strictest([row[f"k{i}"] for i in range(LEVELS)], row["n"], alpha, delta / strata)] if i < LEVELS}


def strictest(rejected: list[int], n: int, alpha: float, level: float) -> int:
    """The first of the levels (strictest first) of which it and all looser ones hold; LEVELS if none does."""
    i = LEVELS
    while i and rejected[i - 1] <= n * alpha and upper_bound(rejected[i - 1], n, level) <= alpha:
        i -= 1
    return i


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs' columns but text, the figures, base_failed and kept."""
    keep = [c for c in docs.columns if c in ("doc_id", "lang", "text")]
    figured = scratch.cut(figures(docs.select(*keep)), "figures")
    found = cutoffs(figured, labels, alpha, delta)
    rule = ratios()
    table = docs.sparkSession.createDataFrame([(lang, *[own[r] for r in rule]) for lang, own in found.items()], "stratum string, " + ", ".join(f"most_{r} double" for r in rule))
    judged = figured.withColumn("base_failed", base_failed()).join(F.broadcast(table) if len(found) <= STRATA else table, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    rejected = F.lit(False)
    for r in rule:
        rejected = rejected | F.coalesce(rule[r] > F.col(f"most_{r}"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum", *[f"most_{r}" for r in rule])
