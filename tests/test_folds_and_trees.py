"""Sorted folds, places, diffs, trees and looked-up paths against brute force, with plans that don't grow."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dupscope.operators import diff, dirs, files, folds, prefixes, ranks


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def exchanges(df):
    return len(re.findall(r"Exchange (?!SinglePartition)\w*partitioning|Exchange SinglePartition|Exchange RoundRobin", plan(df)))


def test_digests_carry_over_batches(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(7)}", f"{rng.randrange(10**6):06d}é", None if rng.random() < 0.0005 else f"h{i}") for i in range(6000)] + [("hot", f"{i:07d}", "x" * 40) for i in range(30_000)] + [("one", "", ""), ("null", "a", None)]
    df = spark.createDataFrame(rows, "k string, o string, h string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = {r.k: r.digest for r in folds.digests(df, "k", ["o", "h"], F.concat("o", F.lit("\0"), "h")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(list)
    for k, o, h in rows:
        by[k].append((o.encode(), h))
    for k, entries in by.items():
        whole = all(h is not None for _, h in entries)
        want = hashlib.sha256(b"".join(o + b"\0" + h.encode() for o, h in sorted(entries))).hexdigest() if whole else None
        assert got.pop(k) == want
    assert not got
    assert folds.digests(df.limit(0), "k", ["o"], F.col("o")).isEmpty()


def test_rates_of_long_series(spark):
    rng = random.Random(2)
    rows = []
    for k in range(5):
        t, d = 0.0, 0
        for _ in range([1, 2, 50, 3000, 700][k]):
            t, d = t + rng.choice([0.1, 0.5, 0.6, 2.0]), d + rng.randrange(1000)
            rows.append((k, t, d, 10**6))
    got = {r.k: r for r in files.progress(spark.createDataFrame(rows, "k long, t double, d long, total long").repartition(3), "k", "t", "d", "total").collect()}
    for k in range(5):
        ema = before = None
        for _, t, d, _ in sorted(r for r in rows if r[0] == k):
            if before:
                now = 0.0 if t - before[0] <= 0.5 else (float(d) - before[1]) / (t - before[0])
                ema = now if ema is None else ema * 0.7 + now * 0.3
            before = (t, float(d))
        rate = ema or 0.0
        assert got[k].rate == rate and got[k].eta == ((10**6 - before[1]) / rate if rate > 1 else None)


@pytest.mark.parametrize("large", [3, 10**6])
def test_places_within_keys(spark, large):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), f"p{i:05d}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, path string").repartition(5)
    want = {p: sorted(q for j, q in rows if j == k).index(p) + 1 for k, p in rows}
    assert {r.path: r.n for r in ranks.within(df, ["k"], "path", "n", large).collect()} == want


def tree(rng, n, deep=4):
    out = {}
    for _ in range(n):
        out["/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, deep))).lstrip("/") + "/f" + rng.choice("12345")] = None if rng.random() < 0.05 else rng.choice("uvw")
    return {re.sub("//+", "/", p): h for p, h in out.items()}


def frame(spark, files_):
    return spark.createDataFrame([(p, len(p), h) for p, h in files_.items()], "path string, size long, hash string")


def brute_levels(files_):
    kids, out = defaultdict(dict), {}
    for p, h in files_.items():
        parts = p.split("/")[1:]
        for i in range(len(parts)):
            kids["/" + "/".join(parts[:i])]["/" + "/".join(parts[: i + 1])] = None
    for d in sorted(kids, key=lambda d: 0 if d == "/" else d.count("/"), reverse=True):
        entries = sorted((c.rsplit("/", 1)[1].encode(), out[c][0] if c in out else files_[c], c) for c in kids[d])
        sign = None if any(s is None for _, s, _ in entries) else hashlib.sha256(b"".join(n + b"\0" + s.encode() + b"\0" for n, s, _ in entries)).hexdigest()
        below = [p for p in files_ if p.startswith(d.rstrip("/") + "/")]
        out[d] = (sign, len(below), sum(map(len, below)), 0 if d == "/" else d.count("/"))
    return out


def levels_of(df):
    return {r["dir"]: (r.sign, r.files, r["size"], r.depth) for r in df.select(*dirs.LEVELS).collect()}


def test_levels_and_updates(spark):
    rng = random.Random(4)
    before = tree(rng, 60)
    levels = dirs.merkle_levels(frame(spark, before))
    assert levels_of(levels) == brute_levels(before)
    for k in (0, 1, 6):
        after = dict(before)
        changed = rng.sample(sorted(after), k)
        for i, p in enumerate(changed):
            if i % 3 == 0:
                del after[p]
            else:
                after[p] = rng.choice(["u", "new", None])
        fresh = [f"/z/y/x/n{i}" for i in range(k // 3)] + (["/top"] if k else [])
        after |= {p: "u" for p in fresh}
        asked = spark.createDataFrame([(p,) for p in changed + fresh], "path string")
        assert levels_of(dirs.merkle_updated(levels, frame(spark, after), asked)) == brute_levels(after)
    gone = spark.createDataFrame([(p,) for p in before], "path string")
    assert levels_of(dirs.merkle_updated(levels, frame(spark, before).limit(0), gone)) == {}
    assert dirs.merkle_levels(frame(spark, before).limit(0)).isEmpty()


def test_deep_trees_have_small_plans(spark):
    deep = lambda n: {"/" + "/".join(f"d{i}" for i in range(n)) + f"/{c}": c for c in "xy"} | {"/e/x": "x", "/e/y": "y"}
    size = {}
    for n in (3, 30):
        found = dirs.merkle_levels(frame(spark, deep(n)))
        assert levels_of(found) == brute_levels(deep(n))
        size[n] = exchanges(found)
    assert size[3] == size[30] <= 2


def brute_diff(old, new):
    """kind, old path, new path; pairs of a key by path order."""
    out, o, n = [], dict(old), dict(new)
    for p in set(o) & set(n):
        out.append(("unchanged" if o[p][:2] == n[p][:2] else "modified", p, p))
    hashes = {v[4] for v in old.values() if v[4] is not None}
    o, n = {p: v for p, v in o.items() if p not in new}, {p: v for p, v in n.items() if p not in old}
    for kind, key in (("moved_inode", lambda v: (v[2], v[3], v[0])), ("moved_hash", lambda v: (v[4],))):
        by = defaultdict(lambda: ([], []))
        for side, rows in enumerate((o, n)):
            for p in sorted(rows):
                if None not in key(rows[p]):
                    by[key(rows[p])][side].append(p)
        for a, b in by.values():
            for x, y in zip(a, b):
                out.append((kind, x, y))
                del o[x], n[y]
    out += [("deleted", p, None) for p in o] + [("new_dup" if v[4] in hashes else "new", None, p) for p, v in n.items()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("large", [2, 10**6])
def test_diff(spark, monkeypatch, large):
    monkeypatch.setattr(ranks, "LARGE", large)
    rng = random.Random(5)
    side = lambda names: {f"/x/{n}": (rng.randrange(2), rng.randrange(2), 1, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "a", "b", "c", "d", "e"])) for n in names}  # noqa: E731  size, mtime, device, inode, hash
    old, new = side(rng.sample(range(300), 120)), side(rng.sample(range(300), 120))
    df = lambda rows: spark.createDataFrame([(p, *v) for p, v in rows.items()], "path string, size long, mtime long, device long, inode long, hash string")
    got = diff.changes(df(old), df(new))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_diff(old, new)
    if large > 2:
        assert exchanges(got) < 15
    empty = df(old).limit(0)
    assert {r.kind for r in diff.changes(empty, df(new)).collect()} == {"new"} and {r.kind for r in diff.changes(df(old), empty).collect()} == {"deleted"}


def test_paths_looked_up(spark):
    rng = random.Random(6)
    have = sorted(tree(rng, 120)) + ["/é/漢", "/-", "/a-"]
    asked = have[::3] + ["/", "/a", "/a/b", "/ab", "/a-/x", "/zzz", "", "/é", "/é/", "/漢", "/c/c/c/c/f9", None, "/a"]
    ask = spark.createDataFrame([(p, i) for i, p in enumerate(asked)], "path string, covered_by int")
    above = {"/"} | {"/".join(p.split("/")[:n]) for p in have for n in range(2, p.count("/") + 1)}
    want = {(p, i): p is not None and (p in have or p in above) for i, p in enumerate(asked)}
    at = prefixes.index(spark.createDataFrame([(p,) for p in have], "path string"))
    assert len(at.firsts) > 1
    got = prefixes.covered(at, ask)
    assert {(r.path, r.covered_by): r.covered for r in got.collect()} == want
    one = prefixes.successors(at, ask.where("path = '/a/b'"), "path", "next")
    assert one.collect()[0].next == min(p for p in have if p >= "/a/b") and len(re.findall(r"cell_=\d+", " ".join(at.table.inputFiles()))) > 1
    none = prefixes.index(spark.createDataFrame([], "path string"))
    assert not any(r.covered for r in prefixes.covered(none, ask).collect())
