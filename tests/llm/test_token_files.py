"""Flat token files read by byte ranges."""

import random

import numpy as np
import pytest

from dupscope.llm import token_counts


@pytest.mark.parametrize("ranges", [True, False])
def test_files_of_many_blocks(spark, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    monkeypatch.setattr(token_counts, "PER_TASK", 3)
    if not ranges:
        monkeypatch.setattr(token_counts, "_by_ranges", lambda path: False)
    rng, want = random.Random(1), {}
    for name, n in (("a b.bin", 1000), ("c.bin", 16), ("d%.bin", 1), ("empty.bin", 0), ("é.bin", 161)):
        ids = [9 if rng.random() < 0.05 else rng.randrange(100, 60_000) for _ in range(n)]
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        runs, k = [], 0
        for i in ids:
            if i == 9:
                runs.append((k, True))
            k = 0 if i == 9 else k + 1
        want[name] = [(o, *r) for o, r in enumerate(runs + ([(k, False)] if k else []))]
    (tmp_path / "_SUCCESS").write_text("")
    blocks = token_counts.read_files(spark, f"file://{tmp_path}")
    names = {r.file: r.path.rsplit("/", 1)[1] for r in blocks.select("file", "path").distinct().collect()}
    got = {n: [] for n in want}
    for r in token_counts.counts(blocks, 9).collect():
        got[names[r.file]].append((r.ordinal, r.n_tokens, r.ended))
    assert {n: sorted(v) for n, v in got.items()} == want
    assert token_counts.read_files(spark, f"file://{tmp_path}/none*").count() == 0


def test_a_file_over_two_gigabytes(spark, tmp_path):
    size = 2 * token_counts.BLOCK
    with open(tmp_path / "big", "wb") as f:
        f.truncate(2100 * size + 6)
        f.seek(2100 * size)
        f.write(np.array([1, 2, 3], "<u2").tobytes())
    blocks = token_counts.read_files(spark, f"{tmp_path}/big")
    last = blocks.where("block >= 2099").selectExpr("block", "octet_length(ids) as n", "hex(right(ids, 6)) as tail").orderBy("block").collect()
    assert [tuple(r) for r in last] == [(2099, size, "000000000000"), (2100, 6, "010002000300")]
