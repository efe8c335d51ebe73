"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for the rest.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there to
``? #`` or the end; a null URL or one without ``://`` has neither.  A rule names a host and a
path prefix and fits that host and its subdomains; the longest rule wins.

Method: trees over length, depth, digit ratio, character entropy, parameter counts and suffix
statistics (share and smoothed bad rate of the labelled URLs of a suffix, the last label of the
host; those of a row that trains come from other rows), trained on a bounded sample of labelled URLs (``TRAIN_ROWS``, in hash order) and
compiled into one SQL expression, so scoring is DataFrame operations only.  A quarter of the
sample only watches, and sets the cut: the lowest score from which on most of the watched URLs are bad
(``WATCHED`` of them at least); where the trees order the watched URLs too badly for that, the cut is ``CUT``.  Without labels of
both kinds the trees are empty and the base rate decides; without any label everything is allowed.
Empty and null URLs get the verdict of their features (all zero, the base rate as suffix rate) like any other.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting, sampling

#: verdict, host, path; the rule's name is host + path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled URLs that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
#: Suffixes with statistics of their own, the most frequent ones; rows that the base rate counts as in a smoothed one.
SUFFIXES, PRIOR = 256, 20
#: Trees; watched URLs that a cut must block at least; the cut where none holds.
ROUNDS, WATCHED, CUT = 30, 5, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, what, ""))).cast("double")


def suffix(url: Column) -> Column:
    return F.regexp_extract(host(url), r"([^.]*)$", 1)


def suffix_stats(rows: list[tuple[str, float]]) -> dict[str | None, tuple[float, float]]:
    """suffix -> bad rate, share of the rows (suffix, bad); under None those of any other suffix."""
    seen, bad = Counter(k for k, _ in rows), Counter(k for k, b in rows if b)
    mean = sum(bad.values()) / len(rows) if rows else 0.5
    top = sorted(seen, key=lambda k: (-seen[k], k))[:SUFFIXES]
    return {None: (mean, 0.0)} | {k: ((bad[k] + PRIOR * mean) / (seen[k] + PRIOR), seen[k] / len(rows)) for k in top}


def suffix_features(url: Column, stats: dict[str | None, tuple[float, float]]) -> dict[str, Column]:
    def of(i: int) -> Column:
        known = [F.lit(x) for k, v in stats.items() if k is not None for x in (k, v[i])]
        other = F.lit(stats[None][i])
        return F.coalesce(F.try_element_at(F.create_map(*known), suffix(url)), other) if known else other

    return {"f_suffix_rate": of(0), "f_suffix_share": of(1)}


def features(url: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    h, p = host(u), path(u)
    last = F.regexp_extract(p, r"([^/]*)$", 1)
    chars = F.array_distinct(F.split(u, ""))
    entropy = F.aggregate(chars, F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise((F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n * F.log2((F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)))
    return {
        "f_length": F.length(u).cast("double"),
        "f_host_length": F.length(h).cast("double"),
        "f_path_length": F.length(p).cast("double"),
        "f_depth": _count(p, "/"),
        "f_labels": _count(h, "."),
        "f_digits": _count(u, "0123456789") / n,
        "f_host_digits": _count(h, "0123456789"),
        "f_hyphens": _count(h, "-"),
        "f_entropy": entropy,
        "f_params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "f_query_length": F.length(query).cast("double"),
        "f_fragment": F.when(u.contains("#"), 1.0).otherwise(0.0),
        "f_secure": F.when(u.startswith("https:"), 1.0).otherwise(0.0),
        "f_suffix": F.length(F.regexp_extract(h, r"([^.]*)$", 1)).cast("double"),
        "f_extension": F.when(last.contains("."), F.length(F.regexp_extract(last, r"\.([^.]*)$", 1))).otherwise(0).cast("double"),
        "f_upper": _count(u, UPPER) / n,
    }


def cut_of(scores: list[float], bad: list[float]) -> float:
    """The lowest score from which on more than half of the watched rows are bad; CUT if there's none."""
    best, seen, wrong = CUT, 0, 0.0
    rows = sorted(zip(scores, bad), reverse=True)
    for i, (x, y) in enumerate(rows):
        seen, wrong = seen + 1, wrong + y
        if (i + 1 == len(rows) or rows[i + 1][0] < x) and seen >= WATCHED and 2 * wrong > seen:
            best = x
    return best


class Fitted(NamedTuple):
    model: tuple[float, list]
    stats: dict[str | None, tuple[float, float]]
    cut: float
    #: Of the watched rows: log loss of the base rate alone and of the trees, and area under the ROC curve.
    base_loss: float
    loss: float
    auc: float


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Fitted:
    """Trees for the odds that a URL is to be blocked, the suffix statistics they read and the cut; labelled: url, bad (0 or 1)."""
    f = features(F.col("url"))
    known = sampling.first_by_hash(labelled.where("bad is not null"), F.xxhash64("url"), rows, "url", "bad").repartition(1)  # else each partition would send so many rows to the driver
    sample = known.select(F.col("bad").cast("double"), F.coalesce(suffix(F.col("url")), F.lit("")), *[c.alias(k) for k, c in f.items()]).collect()
    pairs = [(r[1], r[0]) for r in sample]
    if not sample:
        return Fitted((-30.0, []), suffix_stats(pairs), CUT, 0.0, 0.0, 0.5)
    others = [suffix_stats([x for i, x in enumerate(pairs) if i % 4 not in (k, 3)]) for k in range(4)]  # rows 3, 7, ... only watch
    own = [others[i % 4].get(k, others[i % 4][None]) for i, (k, _) in enumerate(pairs)]
    x, y = np.array([[*r[2:], *o] for r, o in zip(sample, own)]), np.array([b for _, b in pairs])
    watch = np.arange(len(y)) % 4 == 3
    model = boosting.fit(x[~watch], y[~watch], rounds=ROUNDS, rate=0.1, least=5.0)
    odds, seen = boosting.log_odds(model, x[watch]), y[watch]
    loss = lambda z: float(np.mean(np.logaddexp(0, z) - seen * z)) if len(seen) else 0.0
    good, bad = odds[seen == 0], odds[seen == 1]
    auc = float(np.mean((bad[:, None] > good) + 0.5 * (bad[:, None] == good))) if len(good) and len(bad) else 0.5
    return Fitted(model, suffix_stats(pairs), cut_of((1 / (1 + np.exp(-odds))).tolist(), seen.tolist()), loss(model[0]), loss(odds), auc)


def rule_of(h: Column, p: Column, rules=RULES) -> Column:
    """The rule that decides: longest host and path; null if none fits."""
    best = F.lit(None).cast("string")
    for _, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        best = F.when(fits, F.lit(rule_host + rule_path)).otherwise(best)
    return best


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """pages with host, path, rule, score (chance of being bad by the trees) and verdict added; a url column is read.

    Columns of pages with one of the five names are replaced; all others keep their names and values.  Repeated rows each get a row.
    """
    fitted = fit(labelled, rows)
    url = F.col("row.url")
    f = features(url) | suffix_features(url, fitted.stats)
    verdicts = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in rules:
        verdicts = F.when(F.col("rule") == rule_host + rule_path, verdict).otherwise(verdicts)
    own = pages.select(F.struct("*").alias("row")).select("row", host(url).alias("host"), path(url).alias("path"), *[c.alias(k) for k, c in f.items()])
    odds = F.expr(boosting.sql(fitted.model, list(f)))
    out = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", 1 / (1 + F.exp(-odds)))
    out = out.withColumn("verdict", F.coalesce(verdicts, F.when(F.col("score") >= fitted.cut, "block").otherwise("allow")))
    made = ("host", "path", "rule", "score", "verdict")
    return out.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c not in made], *made)


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: a page's number (last digits of its path) names the document that labels judges; quality 0 is bad."""
    number = F.regexp_extract(path(F.col("url")), r"/(\d{1,18})(?:\.[a-z]+)?/?$", 1)
    named = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    return named.join(labels.where("quality is not null").select("doc_id", (1 - F.col("quality")).alias("bad")), "doc_id").select("url", "bad")
