"""Every stage of the pipeline against plain Python on the rows that the stage before kept."""

import bisect
import collections
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from dupscope.llm import line_dedup, queries, scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.cut(stage(spark, docs, SF), name)
        out[name] = docs.collect()
    return out


def rows(found):
    return collections.Counter(map(tuple, found))


def test_quality(spark, stages):
    good = {r.doc_id for r in queries.op4_quality_classifier(spark, SF).collect() if r.score >= 0.7}
    assert rows(stages["quality"]) == rows(r for r in stages["documents"] if r.doc_id in good)
    assert 0 < len(stages["quality"]) < len(stages["documents"])


def test_lines(spark, stages, tmp_path):
    with duckdb.connect() as db:
        spark.createDataFrame(stages["quality"]).coalesce(1).write.parquet(f"{tmp_path}/docs")
        db.sql(f"CREATE VIEW docs AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
        want = {i: t for i, t in db.sql(f"SELECT doc_id, text FROM ({line_dedup.SQL.format(docs='docs')})").fetchall()}
    assert {r.doc_id: r.text for r in stages["lines"]} == want
    before = {r.doc_id: r for r in stages["quality"]}
    for r in stages["lines"]:
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source) and r.n_chars == len(r.text)


def test_near_duplicates(stages):
    fold = {k: k + 32 for k in range(65, 91)}
    sets = {}
    for r in stages["lines"]:
        w = WORD.findall((r.text or "").translate(fold))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    keep = {find(i) for i in sets}
    assert rows(stages["near_duplicates"]) == rows(r for r in stages["lines"] if r.doc_id in keep) and len(keep) < len(sets)


def test_mix(stages):
    words = lambda r: len(WORD.findall(r.text or ""))
    before, after = collections.Counter(), collections.Counter()
    for r in stages["near_duplicates"]:
        before[r.source] += words(r)
    times = rows(stages["mix"])
    for r in stages["mix"]:
        after[r.source] += words(r)
    assert set(times) <= set(rows(stages["near_duplicates"])) and max(times.values()) <= 3
    named = sorted((s for s in before if s is not None)) + [s for s in before if s is None]
    weight, cap, total = dict(zip(named, (5, 2, 1) * len(named))), {s: 3 * n for s, n in before.items()}, sum(before.values())
    target, free = {}, set(named)
    while True:  # what passes a cap goes to the others by weight
        left, share = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / share > cap[s]}
        target |= {s: cap[s] for s in over}
        free -= over
        if not over:
            target |= {s: left * weight[s] / share for s in free}
            break
    longest = max(map(words, stages["near_duplicates"]))
    assert all(abs(after[s] - target[s]) <= max(longest, 0.02 * target[s]) for s in named)
    assert abs(sum(after.values()) - total) <= 3 * longest


def test_pack(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want, lengths = collections.Counter(), []
    for r in stages["mix"]:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(r.doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
            lengths.append(len(part))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages["pack"]) == want
    filled = collections.defaultdict(list)
    for r in stages["pack"]:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    gaps = []  # best fit, longest first
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else 2048) - n)
    assert len(filled) == len(gaps)
