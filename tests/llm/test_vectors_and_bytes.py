"""Whitening, byte-level BPE and centroid clustering against brute force, on odd inputs too."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
import tiktoken

from dupscope.llm import byte_bpe, clustering, queries, whitening

SF = "/root/testdata/sf0.001"
BAD = [(9001, None), (9002, []), (9003, [1.0, None]), (9004, [float("nan")] * 8), (9005, [float("inf")] * 8), (9006, [1.0])]


def brute_white(rows, k):
    """id -> (deviation, whitened of each component), explained, n; the sign of a component is free."""
    x = {i: tuple(math.floor(64 * float(c)) + 1000000 for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    real = lambda v: np.array([(n * a - b) / n for a, b in zip(v, s)])
    m = np.array([real(v) for v in fit])
    e, w = np.linalg.eigh(m.T @ m / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return {i: (sum((n * a - b) ** 2 for a, b in zip(v, s)), real(v) @ w / np.sqrt(e)) for i, v in x.items()}, e / np.trace(m.T @ m / n), n


def check_white(got, rows, k):
    want, explained, n = brute_white(rows, k)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want) and all(sorted(c) == list(range(1, k + 1)) for c in by.values())
    signs = [None] * k
    for i, (deviation, white) in want.items():
        for c in range(k):
            r = by[i][c + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9
            assert abs(abs(r.whitened) - abs(white[c])) < 1e-6
            if abs(white[c]) > 1e-3:
                sign = (r.whitened > 0) == (white[c] > 0)
                assert signs[c] in (None, sign)
                signs[c] = sign


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(300, 8)) @ np.diag([8, 5, 3, 2, 1, 0.5, 0.2, 0.1]) @ rng.normal(size=(8, 8))).astype(np.float32)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    return rows + [(1000 + i, rows[0][1]) for i in range(150)]


def test_whitening(spark, vectors):
    table = spark.createDataFrame(vectors + BAD, "vec_id long, embedding array<float>").repartition(7)
    check_white(whitening.whiten(table, 5).collect(), vectors, 5)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_white(queries.op11_whitening(spark, SF).collect(), rows, 16)


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, whitened int, n string"
    of = lambda rows: whitening.whiten(spark.createDataFrame([(*r, 1, "x") for r in rows], kind)).collect()
    assert of([]) == of(BAD[:4]) == of([(1, [1.0, 2.0])] * 3) == []
    two = of([(None, [1.0, 5.0]), (None, [1.0, 5.0]), (3, [2.0, 5.0])])  # one dimension varies
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in two) == [("3", 1, 2, 64**2, 1.0, 1.0)] + [("None", 1, 2, 64**2, 1.0, 1.0)] * 2
    far = of([(1, [float(1 << 35)]), (2, [0.0]), (3, [-float(1 << 35)])])  # deviations that don't fit
    assert sorted((r.vec_id, r.deviation) for r in far) == [(1, None), (2, 0), (3, None)]


@pytest.mark.parametrize("fan", [2, 64])
def test_tall_r_and_jacobi(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (2000, 7)) + 1_000_000
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(9)
    n, s = whitening.totals(fit, 7)
    assert n == 2000 and list(s) == x.sum(0).tolist()
    r = whitening.reduced(fit, 7, n, s)
    real = x - x.mean(0)
    assert np.allclose(r.T @ r, real.T @ real, rtol=1e-10) and np.allclose(r, np.triu(r))
    small = np.diag([1e8, 1e4, 1, 1e-4, 1e-8]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    for m in (r, rng.normal(size=(6, 6)), small, np.zeros((3, 3)), np.ones((4, 4)), np.ones((1, 1))):
        length, v = whitening.jacobi(m)
        assert np.allclose(v.T @ v, np.eye(m.shape[1])) and (np.diff(length) <= 0).all()
        assert np.allclose(np.sqrt(((m @ v) ** 2).sum(0)), length) and np.allclose(length, np.linalg.svd(m)[1])
    assert np.allclose(whitening.jacobi(small)[0], [1e8, 1e4, 1, 1e-4, 1e-8], rtol=1e-12)  # small ones keep their digits


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    v = byte_bpe.vocabulary(byte_bpe.default_path())
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


LETTERS = "abcdefghijklmnopqrstuvwxyz ABE'trsvmld  \n\t0123éß漢😀!?.,-_"


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_are_the_tokenizers(reference, monkeypatch):
    v, own = reference
    rng = random.Random(5)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 20_000, "ab" * 10_000, " " * 30_000, "\n" * 3000 + "x", "".join(rng.choices("etaoinshrdlu", k=50_000)), "<|endoftext|>", "\x00\x1c\x85 ﻿", "it's they'Re I'm' 're'x"]
    for text in texts * 2:
        assert ids(v.encode(text)) == own.encode_ordinary(text)
        assert v.decode(v.encode(text)) == text.encode()
    monkeypatch.setattr(byte_bpe, "RUN", 7)  # long texts go by runs
    for text in texts[:300]:
        assert ids(v.encode(text)) == own.encode_ordinary(text) and v.decode(v.encode(text)) == text.encode()


def test_each_prefix_has_its_encodings_last_token(reference):
    v, own = reference
    from array import array

    for text in ("unbelievable", "aaaaaaaaaaa", "xqzjkvw", "internétional漢", "0000000"):
        data, last = text.encode(), array("I")
        v.extend(data, last)
        assert [v.merged(data[: n + 1])[-1] for n in range(len(data))] == last.tolist()


def test_appends_and_edits_are_exact_and_near(reference):
    v, own = reference
    rng = random.Random(6)
    for _ in range(400):
        kept = byte_bpe.Prefixes(v, "".join(rng.choices(LETTERS, k=rng.randint(0, 80))))
        for _ in range(6):
            i = rng.randint(0, len(kept.text))
            text, j, new = kept.text, min(len(kept.text), i + rng.choice([0, 0, 1, 3, 10])), "".join(rng.choices(LETTERS, k=rng.choice([0, 1, 2, 8])))
            kept.replace(i, j, new)
            assert kept.text == text[:i] + new + text[j:] and kept.ids() == own.encode_ordinary(kept.text)
        kept.append("".join(rng.choices(LETTERS, k=5)))
        assert kept.ids() == own.encode_ordinary(kept.text)
    one = byte_bpe.Prefixes(v, "".join(rng.choices("etaoinshrdlu", k=30_000)))  # a single piece
    many = byte_bpe.Prefixes(v, " ".join("".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(5000)))
    for kept in (one, many):
        before = kept.computed
        kept.replace(12_000, 12_003, "xyzw")
        kept.append("abc")
        assert kept.computed - before <= 4 * v.longest and kept.ids() == own.encode_ordinary(kept.text)


def test_ranks_that_do_not_rise(tmp_path):
    """A file where a part ranks above the whole, and tokens that merging never gives."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"cd", b"bcd", b"zzz"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    v = byte_bpe.Vocabulary(str(path), r"\S+|\s+")
    own = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choices("abcdz ", k=rng.randint(0, 12)))
        assert ids(v.encode(text)) == own.encode_ordinary(text)


def test_encoding_tables(spark, reference):
    v, own = reference
    texts = [None, "", " ", "twice", "twice", "é漢 \n\n", "long " * 300_000]
    docs = spark.createDataFrame([(None if i == 3 else i, t, f"{i}") for i, t in enumerate(texts)], "doc_id long, text string, ids_ string")
    made = byte_bpe.decode(byte_bpe.encode(docs))
    assert made.columns == ["doc_id", "text", "ids_", "decoded_"]
    for r in made.collect():
        assert ids(r.ids_) == own.encode_ordinary(r.text or "") and bytes(r.decoded_) == (r.text or "").encode()
    want = sorted((str(None if i == 3 else i), len(own.encode_ordinary(t or "")), hashlib.sha256(np.array(own.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts))
    assert sorted((str(r.doc_id), *r[1:]) for r in byte_bpe.digests(docs).collect()) == want
    assert byte_bpe.digests(docs.limit(0)).collect() == []
    assert made.where("decoded_ = cast('twice' as binary)").count() == 2


def test_encoding_of_the_table(spark, reference):
    v, own = reference
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = own.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def brute_clusters(rows, centroids, rounds, size):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) and abs(c) < 1 << 17 for c in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [x for _, x in sorted(kept, key=rank)[:centroids]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in set(own):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            c[j] = [sum(k) // len(mine) for k in zip(*mine)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = {j: sum(d for _, o, d in out if o == j) for _, j, _ in out}
    return sorted(((str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out))


def clusters(table, **how):
    return sorted((str(r[0]), *r[1:]) for r in clustering.cluster(table, **how).collect())


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_clustering(spark, spread):
    """With a small spread components are few integers, so distances tie and copies abound."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=6) * spread)]) for i in range(250)]
    rows += [(None if i % 3 else 7, rows[5][1]) for i in range(60)] + BAD + [(9010, [1.0] * 5), (9011, [float(1 << 30)] * 6), (9012, [100_000.0] * 6)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, id string").repartition(5)
    for centroids, rounds in ((1, 1), (12, 5), (40, 2), (500, 1)):
        assert clusters(table, centroids=centroids, rounds=rounds, components=6) == brute_clusters(rows, centroids, rounds, 6)


def test_first_centroids_of_many_rows(spark):
    rows = [(i if i % 2 else 4, [float(i % 9)]) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clusters(table, centroids=3, rounds=1, components=1) == brute_clusters(rows, 3, 1, 1)
    same = [(4, [float(i % 9)]) for i in range(4000)]
    assert clusters(spark.createDataFrame(same, "vec_id long, embedding array<float>"), centroids=3, rounds=1, components=1) == brute_clusters(same, 3, 1, 1)


def test_clustering_of_nothing(spark):
    empty = spark.createDataFrame(BAD, "vec_id long, embedding array<float>")
    assert clusters(empty) == clusters(empty.limit(0)) == []


def test_scan_stops_strictly_beyond_twice():
    c = np.array([[6], [0], [30]])
    order, apart = clustering.orders(c)
    near, far, seen = clustering.assign(np.array([[3], [29], [0]]), np.array([0, 0, 1]), c, order, apart)
    assert near.tolist() == [0, 2, 1] and far.tolist() == [9, 1, 0]
    assert clustering.assign(np.array([[3]]), np.array([1]), c, order, apart)[0].tolist() == [0]  # exactly twice: a tie, the smaller number
    assert seen < 9
    rng = np.random.default_rng(0)
    x, c = rng.integers(-50, 50, (3000, 2)), rng.integers(-50, 50, (40, 2))
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    near, far, seen = clustering.assign(x, every.argmin(1), c, *clustering.orders(c))
    assert near.tolist() == every.argmin(1).tolist() and far.tolist() == every.min(1).tolist() and seen < every.size / 4


def test_clustering_of_the_table_by_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        want = db.sql(queries.oracle_sql()["op13_centroid_clustering"])
        columns, rows = want.columns, want.fetchall()
    got = queries.op13_centroid_clustering(spark, SF)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(rows)
