"""Pages, identities, verification by blocks, walks by rounds, exports in parts and free names."""

import csv
import hashlib
import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dupscope.operators import export, groups, pages, panels, plan
from dupscope.sources import walker
from dupscope.sources.identity import IdentityIndex


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def explained(df):
    return df._jdf.queryExecution().toString()


def test_pages_read_only_their_ranges(spark):
    rng = random.Random(1)
    rows = [("a" * 64 if i % 3 else f"{i % 40:064x}", f"/p/{rng.random():.9f}", i) for i in range(3000)]
    at = pages.index(spark.createDataFrame(rows, "hash string, path string, n long").repartition(6))
    by = defaultdict(list)
    for h, p, n in rows:
        by[h].append((p, n))
    paths = lambda df: [r.path for r in df.collect()]
    assert len(at.cells) == 4
    for h in ("a" * 64, f"{0:064x}", f"{39:064x}"):
        want = sorted(p for p, _ in by[h])
        for offset, limit in ((0, 5), (3, 1000), (len(want) - 2, 50), (len(want), 5), (990, 20)):
            assert paths(pages.page(at, h, offset, limit)) == want[offset : offset + limit]
        for start in ("", want[0], want[len(want) // 2], "/p/0.5", "/zzz"):
            assert paths(pages.after(at, h, start, 7)) == [p for p in want if p > start][:7]
    one = pages.page(at, "a" * 64, 700, 10)
    assert "cell_ IN" in explained(one) or "cell_" in explained(one)
    assert len(set(re.findall(r"cell_=\d+", " ".join(at.table.inputFiles())))) == 4
    assert one.columns == ["hash", "path", "n"] and [r.n for r in one.collect()] == [n for _, n in sorted(by["a" * 64])[700:710]]
    assert paths(pages.page(at, "nothing", 0, 5)) == paths(pages.page_of_hash(at, "zz")) == paths(pages.page_of_hash(at, "a" * 63)) == []
    assert paths(pages.page_of_hash(at, "A" * 64, 1, 2)) == sorted(p for p, _ in by["a" * 64])[1:3]
    numbers = {r.path: (r.hash, r.page) for r in pages.numbered(at, 10).collect()}
    assert numbers == {p: (h, i // 10) for h, own in by.items() for i, (p, _) in enumerate(sorted(own))}
    none = pages.index(spark.createDataFrame([], "hash string, path string"))
    assert paths(pages.page(none, "a", 0, 5)) == paths(pages.after(none, "a", "", 5)) == paths(pages.numbered(none, 5)) == []


KEY = ("path", "size", "mtime", "mtime_nsec", "ctime_sec", "ctime_nsec")


def test_identities_join_without_moving_the_history(spark, tmp_path):
    kind = "scan_id long, path string, size long, mtime long, mtime_nsec long, ctime_sec long, ctime_nsec long, hash string, identity_version int"
    rng = random.Random(2)
    row = lambda scan: (scan, f"/{rng.randrange(60)}", rng.randrange(2), 1, rng.randrange(2), None if rng.random() < 0.05 else 1, 1, rng.choice([None, "a", "b", "c"]), rng.choice([1, 1, 0]))
    scans = {s: [row(s) for _ in range(150)] for s in (5, 3, 9)}
    index = IdentityIndex(spark, f"file://{tmp_path}/index", 4)
    target = spark.createDataFrame([row(99) for _ in range(150)], kind)
    assert not any(r.inherited for r in index.inherit(target).collect())
    best = {}
    for scan, rows in scans.items():  # older scans may come later
        index.add(spark.createDataFrame(rows, kind))
        for r in rows:
            if r[8] == 1 and r[7] is not None:
                best[r[1:7]] = max(best.get(r[1:7], (0, "")), (scan, r[7]))
    again = IdentityIndex(spark, f"file://{tmp_path}/index", 4)  # as another session opens it
    got = again.inherit(target)
    asked = [tuple(r[k] for k in KEY) for r in target.collect() if r.hash is None]
    after = {tuple(r[k] for k in KEY): r.hash for r in got.collect() if r.inherited}
    assert after == {k: best[k][1] for k in asked if k in best and None not in k} and len(after) > 5
    assert got.where("not inherited").count() + sum(k in after for k in asked) == 150
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = explained(again.inherit(target)).split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1


def test_a_half_written_index_is_not_read(spark, tmp_path):
    kind = "scan_id long, path string, size long, mtime long, mtime_nsec long, ctime_sec long, ctime_nsec long, hash string, identity_version int"
    index = IdentityIndex(spark, f"file://{tmp_path}/index", 2)
    index.add(spark.createDataFrame([(1, "/a", 1, 1, 1, 1, 1, "h", 1)], kind))
    os.makedirs(tmp_path / "index" / "2")
    (tmp_path / "index" / "2" / "part-0").write_text("half")
    assert [r.known_hash for r in index.table().collect()] == ["h"]


def brute_verified(members, content):
    out = set()
    by = defaultdict(list)
    for h, p, _ in members:
        if p in content:
            by[h].append(p)
    for h, own in by.items():
        first = min(own)
        same = [p for p in own if content[p] == content[first]]
        if len(same) >= 2:
            out |= {(h, p, len(same)) for p in same}
    return out


@pytest.fixture
def copies(tmp_path):
    rng = random.Random(3)
    content, members = {}, []
    for g, size in enumerate([0, 1, 7, 8, 9, 64, 200, 1000, 8 * 130]):
        base = bytes(rng.randrange(256) for _ in range(size))
        for i in range(rng.randint(2, 5)):
            own = bytearray(base)
            if size and rng.random() < 0.4:
                own[rng.choice([0, size // 2, size - 1])] ^= 1
            p = f"{tmp_path}/g{g}-{i}"
            members.append((f"h{g}", p, size))
            content[p] = bytes(own)
    many = bytes(300)
    for i in range(40):
        p = f"{tmp_path}/many-{i:02d}"
        members.append(("many", p, 300))
        content[p] = many[:-1] + b"x" if i % 7 == 3 else many
    members += [("gone", f"{tmp_path}/gone-{i}", 5) for i in range(3)] + [("lone", f"{tmp_path}/lone", 3)]
    content[f"{tmp_path}/gone-1"] = content[f"{tmp_path}/gone-2"] = b"abcde"
    content[f"{tmp_path}/lone"] = b"abc"
    return members, content


@pytest.mark.parametrize("files", [False, True])
def test_verification_by_blocks(spark, monkeypatch, copies, files):
    monkeypatch.setattr(groups, "SPREAD", 7)
    monkeypatch.setattr(walker, "RUN", 3)
    members, content = copies
    df = spark.createDataFrame(members, "hash string, path string, size long")
    if files:
        for p, data in content.items():
            with open(p, "wb") as f:
                f.write(data)
        source = walker.file_blocks(8)
    else:
        source = spark.createDataFrame([(p, bytearray(c)) for p, c in content.items()], "path string, content binary")
    got = groups.verified(df, source, 8)
    assert {(r.hash, r.path, r.file_count) for r in got.collect()} == brute_verified(members, content)


def test_blocks_beyond_two_gigabytes(spark, tmp_path):
    size, at = 1 << 20, 2100
    for name, mark in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        with open(tmp_path / name, "wb") as f:
            f.truncate(at * size + 5)
            f.seek(at * size)
            f.write(mark)
    rows = spark.createDataFrame([(f"{tmp_path}/{n}", at * size + 5) for n in "abc"], "path string, size long")
    got = {r.path[-1]: (r.block, bytes(r.data)) for r in walker.file_blocks(size)(rows, at, at + 10).collect()}
    assert got == {n: (at, m + bytes(4)) for n, m in (("a", b"x"), ("b", b"x"), ("c", b"y"))}


def test_walk_by_rounds(spark, tmp_path):
    root = tmp_path / "tree"
    deep = root
    for i in range(12):
        deep = deep / f"d{i}"
    deep.mkdir(parents=True)
    (deep / "leaf").write_text("x")
    (root / "wide").mkdir()
    for i in range(300):
        (root / "wide" / f"f{i}").write_text(str(i))
        (root / "wide" / f"s{i}").mkdir()
    (root / "é").mkdir()
    os.symlink(root, root / "loop")
    os.symlink(root / "nowhere", root / "dangling")
    os.mkfifo(root / "pipe")
    bad = os.fsencode(str(root)) + b"/\xff\xfe"
    with open(bad, "wb") as f:
        f.write(b"x")
    (tmp_path / "one").write_text("yy")
    want = sorted([f"{deep}/leaf", f"{tmp_path}/one", *[f"{root}/wide/f{i}" for i in range(300)]])
    for budget in (7, 10_000):
        found, skipped = walker.walk(spark, [str(root), str(tmp_path / "one"), str(tmp_path / "none")], budget=budget)
        rows = {r.path: r for r in found.collect()}
        assert sorted(rows) == want and rows[f"{tmp_path}/one"].size == 2
        s = os.stat(tmp_path / "one")
        assert (rows[f"{tmp_path}/one"].mtime, rows[f"{tmp_path}/one"].mtime_nsec, rows[f"{tmp_path}/one"].inode) == (s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, s.st_ino)
        assert sorted((r.path.removeprefix(str(root)), r.reason) for r in skipped.collect()) == [("/\\xff\\xfe", "name"), ("/pipe", "kind"), (f"{tmp_path}/none", "unreadable")]
    found, skipped = walker.walk(spark, [str(root)], follow=True)
    assert sorted(r.path for r in found.collect()) == [p for p in want if "/tree/" in p]
    assert sorted((r.path.removeprefix(str(root)), r.reason) for r in skipped.collect()) == [("/\\xff\\xfe", "name"), ("/dangling", "unreadable"), ("/loop", "loop"), ("/pipe", "kind")]


def test_hashes_of_what_the_manifest_says(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text("same")
    found, _ = walker.walk(spark, [str(tmp_path)])
    other = found.withColumn("mtime_nsec", F.when(F.col("path").endswith("b"), F.col("mtime_nsec") + 1).otherwise(F.col("mtime_nsec"))).withColumn("ctime_sec", F.when(F.col("path").endswith("c"), F.col("ctime_sec") - 1).otherwise(F.col("ctime_sec")))
    got = {r.path[-1]: (r.hash, r.error) for r in walker.hashed(other).collect()}
    assert got == {"a": (hashlib.sha256(b"same").hexdigest(), None), "b": (None, "changed since the walk: mtime_nsec"), "c": (None, "changed since the walk: ctime_sec")}


def test_csv_in_parts(spark, tmp_path):
    rows = [(i % 9, f"h{i % 9}", f"/p/{i:04d}," if i % 5 else f'=cmd "{i}"\n', i, 10) for i in range(500)]
    members = spark.createDataFrame(rows, "rank long, hash string, path string, mtime long, size long")
    export.write_csv(members, f"file://{tmp_path}/out")
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part-"))
    assert len(parts) == 5
    export.joined(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/one.csv")
    with open(tmp_path / "one.csv", newline="") as f:
        read = list(csv.reader(f))
    keep = {g: max(r[3] for r in rows if r[0] == g) for g in range(9)}
    guard = lambda p: "'" + p if p.startswith("=") else p
    want = [(str(g), "true" if keep[g] == m else "false", "10", h, guard(p)) for g, h, p, m, _ in rows]
    assert read[0] == ["group", "keep", "size_bytes", "hash", "path"] and sorted(map(tuple, read[1:])) == sorted(want)
    assert [int(r[0]) for r in read[1:]] == sorted(int(r[0]) for r in read[1:])


def test_scripts(spark, tmp_path):
    rows = spark.createDataFrame([("delete", "/t/it's", "/t/k", 5, "h", 0, 0), ("hardlink", "/t/b\nrm x", "/t/k", 6, "h", 0, 0), ("delete", "/u/c", "/t/k", 7, "h", 9, 0)], "kind string, target string, keeper string, size long, hash string, target_device long, keeper_device long")
    sets = spark.createDataFrame([("p/t", "/t", 0, True)], "name string, mountpoint string, device_id long, snapdir_visible boolean")
    text = lambda df: [r.line for r in df.orderBy("section", "target", "step").collect()]
    export.write_script(plan.script(rows, "S", sets, "/sbin/zfs"), f"file://{tmp_path}/s")
    export.joined(spark, f"file://{tmp_path}/s", f"file://{tmp_path}/s.sh")
    lines = (tmp_path / "s.sh").read_text().splitlines()
    assert "/sbin/zfs snapshot 'p/t@S'" in lines and "# 3 actions free about 18 B." in lines and lines[0] == "#!/usr/bin/env bash"
    assert lines.index("/sbin/zfs snapshot 'p/t@S'") < lines.index("# 3 actions free about 18 B.")
    assert any(x.startswith("# skip: ") for x in lines) and not any("rm x" == x for x in lines if x.startswith("#"))
    assert os.system(f"bash -n {tmp_path}/s.sh") == 0
    refused = text(plan.script(rows, "S", sets))
    assert refused[-1] == "exit 1" and not any(x.startswith(("mv", "ln", "cp")) for x in refused)
    assert text(plan.script(rows.limit(0), "S", sets))[-1] == "# The plan is empty."


def test_free_names_in_many_directories(spark):
    rng = random.Random(4)
    there = {(f"/d{rng.randrange(3)}", rng.choice(["a.txt", "b", f"a.dup{rng.randrange(1, 6)}.txt", f"b.{rng.randrange(1, 6)}", f"b.dup{rng.randrange(1, 4)}"])) for _ in range(40)}
    rows = [(f"/s/{i}", f"/d{rng.randrange(3)}", *rng.choice([("a.txt", "duplicate"), ("b", "renamed"), ("b", "duplicate"), ("a.txt", "renamed"), ("c", "moved")])) for i in range(60)]
    want, taken = {}, set(there)
    for p, d, n, how in sorted(rows):
        if how == "moved":
            want[p] = n
            continue
        stem, _, ext = n.rpartition(".") if "." in n[1:] else (n, "", "")
        form = (lambda k: f"{stem}.dup{k}{'.' + ext if ext else ''}") if how == "duplicate" else (lambda k: f"{n}.{k}")
        k = next(k for k in range(1, 1000) if (d, form(k)) not in taken)
        want[p] = form(k)
        taken.add((d, form(k)))
    out = panels.numbered_names(spark.createDataFrame(rows, "path string, dir string, name string, decision string"), spark.createDataFrame(sorted(there), "dir string, name string"))
    assert {r.path: r.new_name for r in out.collect()} == want
