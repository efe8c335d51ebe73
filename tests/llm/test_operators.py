"""The operators of the subpackage against brute force, on small fixtures with nulls, empties, ties and repeats."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dupscope.llm import boosting, html_text, line_dedup, mixing, neighbours, ngram_jaccard, packing, quality_classifier, quality_rules, token_counts, tokens, url_filter

SF = "/root/testdata/sf0.001"
FOLD = {k: k + 32 for k in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 90):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "\n".join([" ".join(w[:9]), " ".join(w[9:])])))
    rows += [(90, None), (91, ""), (92, " \t\n"), (93, "one two"), (94, "One  TWO"), (95, "one two three")]
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 11 else None, "en", len(t or ""), i) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long, component_id long")


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
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
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(docs):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.join(docs).collect()}
    assert got == want
    assert sorted(r.doc_id for r in ngram_jaccard.keep_one(docs).collect()) == sorted({c for _, c in want.values()})


def brute_links(sets):
    """The smallest index reachable from each set by links of similarity 3/4 or more."""
    top = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if ngram_jaccard.similar(sets[a], sets[b], (3, 4)) and top[a] != top[b]:
                lo, hi = sorted((top[a], top[b]))
                top = [lo if x == hi else x for x in top]
    return top


def reached(links, n):
    found = ngram_jaccard.Links(np.arange(n))
    for i, j in links:
        found.add(i, j)
    return found.roots().tolist()


def random_sets(rng, n, size, edits):
    """n unrelated sets and an edited copy of each."""
    new = lambda k: rng.integers(0, 1 << 63, k).astype(np.uint64)
    sets = [np.unique(new(size)) for _ in range(n)]
    return sets + [np.unique(np.concatenate([s[e:], new(e)])) for s in sets for e in [int(rng.integers(0, edits))]]


@pytest.mark.parametrize("n, size, edits", [(60, 12, 4), (40, 300, 90), (12, 2500, 700), (8, 6000, 1800)])
def test_trees_link_what_is_similar(n, size, edits):
    sets = random_sets(np.random.default_rng(size), n, size, edits)
    links = ngram_jaccard.connect(sets, np.arange(len(sets)), (3, 4))
    assert len(links) < len(sets) and all(ngram_jaccard.similar(sets[i], sets[j], (3, 4)) for i, j in links)
    assert reached(links, len(sets)) == brute_links(sets)


@pytest.mark.parametrize("size", [50, 500, 2000, 5000])
def test_inner_nodes_are_pruned(size):
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(128)]
    order = np.argsort([s[0] for s in sets])
    tree = ngram_jaccard.Tree(order, sets, 1 << (4 * size - 1).bit_length())
    done = ngram_jaccard.traverse(tree, tree, sets, (3, 4), ngram_jaccard.Links(np.arange(len(sets))))
    assert done["compared"] == 0 and done["opened"] < done["met"] / 2 and done["met"] < 128 * 127 / 2


def test_copies_are_linked_once():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 200, 8)), rng.integers(0, 1 << 63, 8).astype(np.uint64)])) for _ in range(1500)]
    tree = ngram_jaccard.Tree(np.argsort([s[0] for s in sets]), sets, 1024)
    links = ngram_jaccard.Links(np.arange(len(sets)))
    done = ngram_jaccard.traverse(tree, tree, sets, (3, 4), links)
    assert len(links.made) == 1499 and done["compared"] < 3000


@pytest.mark.parametrize("block", [200, 700])
def test_jaccard_large_neighbourhoods(spark, monkeypatch, block):
    """Blocks of a few shingles: neighbourhoods and groups are cut, and meet again in leaders and block pairs."""
    rng = random.Random(8)
    rows = []
    for family in range(6):
        base = [f"w{family}x{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(25):
            w = base[:]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_repeated_ids(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (5, y), (7, z), (None, y), (9, y + " more"), (8, None), (11, "")]
    got = sorted(map(tuple, ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 26, 3), (5, 26, 3), (5, 26, 3), (5, 26, 3), (7, 26, 7), (None, 26, None), (9, 27, 3), (8, 0, 8), (11, 0, 11)], key=str)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ngram_jaccard.join(none).count() == 0
    assert packing.pack(none).count() == 0
    assert mixing.taken(none).count() == 0
    assert line_dedup.dedup(none).count() == 0
    assert token_counts.of_documents(none).count() == 0
    assert quality_classifier.classify(none, labels).count() == 0
    assert quality_rules.judge(none, labels).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    v = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.search(v, v).count() == 0


def test_html(spark):
    rng = random.Random(77)
    wrong = 0
    for _ in range(60):
        page, main = html_text.generated(rng)
        want = [x.text for x in html_text.parse(page) if x.leaf and x.text in main]
        wrong += html_text.texts([page], html_text.trained()) != ["\n".join(want)]
    assert wrong <= 3
    page = '<html><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p><b>First  one.<br><p>Second\n one, longer than that.</article><footer>&copy; x</footer>'
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in html_text.extract(rows).collect()} == {1: ("A & B\nFirst one.\nSecond one, longer than that.", 46), 2: ("", 0), 3: ("", 0)}


def test_boosting_sql_is_the_model(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    model = boosting.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float), rounds=10)
    rows = spark.createDataFrame(x[:50].tolist(), "a double, b double, c double").select(F.expr(boosting.sql(model, ["a", "b", "c"]))).collect()
    assert [r[0] for r in rows] == pytest.approx(boosting.log_odds(model, x[:50]).tolist())


def test_urls(spark):
    urls = ["https://EXAMPLE.com/en/71?x", "http://a.com/en/", "http://com/en/x", "https://b.net/de/1", "http://w.example.net/de/81", "http://x.org/es/", "http://xcom/en/", "no scheme", None, "http://h", "http://h?a/b", "http://a.example.com/en/8#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame([], "url string, bad int")).collect()}
    assert [out[i].rule for i in range(12)] == ["example.com/en/7", "com/en/", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, None, "com/en/"]
    assert [out[i].verdict for i in range(12)] == ["allow", "block", "block", "allow", "block", "block", *["allow"] * 5, "block"]
    assert (out[0].host, out[0].path) == ("example.com", "/en/71") and (out[10].host, out[10].path) == ("h", "") and (out[8].host, out[8].path) == ("", "")


def test_classifier_on_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_classifier.classify(d, labels)
    assert out.count() == d.count() and out.where("score_ is null or score_ < 0 or score_ > 1").count() == 0
    held = out.where("held_out_").join(labels, "doc_id")
    assert held.where("quality = predicted_").count() / held.count() > 0.97
    assert {r.doc_id for r in out.where("held_out_").collect()} == {r.doc_id for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    long = spark.createDataFrame([(500, "word " * 5000), (501, "a " * 2047), (93, "one two")], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(long)
    out = packing.pack(every).toPandas()
    tok = Tokenizer.from_file(tokens.default_path())
    want = collections.Counter()
    for r in every.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want[(r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))] += 1
    assert collections.Counter(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == np.concatenate([[0], g["length"].cumsum()[:-1]]).tolist() and g["length"].sum() <= 2048


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(20):
        items = [rng.randint(1, 40) for _ in range(200)]
        gaps = []
        for x in sorted(items, reverse=True):
            fit = [g for g in gaps if g >= x]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else 40) - x)
        runs = packing.plan(dict(collections.Counter(items)), 40)
        assert 1 + max(b + r1 - r0 - 1 for _, r0, r1, b, _ in runs) == len(gaps)


def test_odd_texts_have_the_tokenizer_ids():
    enc = tokens.encoder(tokens.default_path())
    for x in ["İstanbul ǅ ﬁn straße İ", "a\x1cb  c\x85d", "don't I'll 12ab <|endoftext|> x", "日本語 テスト", "é é", "ÀÉ!! ok..", "ª º ×÷", ""]:
        assert enc.text(x.encode()) == np.array(enc.whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).round(2)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [1.0] * 7 + [None]), (704, [math.inf] + [1.0] * 7)]
    v = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = neighbours.search(v, v.where("id % 20 = 0"), centroids=8).toPandas()
    exact = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(600), d))[:10]
        hits += len(set(order) & set(g.vec_id))
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 11)) and q not in set(g.vec_id)
        assert np.allclose(g.score, d[g.vec_id])
    assert out.query_id.nunique() == 30 and hits / 300 >= 0.9
    few = neighbours.search(v.where("id < 4"), v.where("id < 4"))
    assert few.count() == 12


def test_mix(spark, docs):
    out = mixing.taken(docs).toPandas()
    again = mixing.taken(docs).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert out["size"].sum() == sum(len(words(r.text)) for r in docs.collect()) and (out.taken <= 3 * out["size"]).all()
    size = out.groupby("source", dropna=False)["size"].sum()
    order = sorted((s for s in size.index if isinstance(s, str))) + [None]
    weight = dict(zip(order, [5, 2, 1, 5, 2, 1]))
    cap = {s: 3 * out[out.source.isna() if s is None else out.source == s]["size"].sum() for s in order}
    target, left, free = {}, float(size.sum()), list(order)
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap[s]]
        target |= {s: float(cap[s]) for s in over} or share
        left -= sum(cap[s] for s in over)
        free = [s for s in free if s in over and False or s not in over] if over else []
    for s in order:
        own = out[out.source.isna() if s is None else out.source == s]
        assert own.target.iloc[0] == pytest.approx(target[s])
        assert abs(own.taken.sum() - target[s]) <= max(own["size"].max(), 1)
    assert mixing.mixed(docs).count() == int(out.times.sum())


def test_line_dedup(spark, docs):
    rows = [(1, "a b\nc\nd\ne\nf"), (2, "x\nc\nd\ne\ny"), (3, "c\n\nd\n \ne\nz"), (4, "q\nq\nq\nq\nq"), (5, None), (6, ""), (7, "c\nd"), (8, "c\nd\ne\n")]
    table = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select(F.col("doc_id") + 1000, "text"))
    got = {r.doc_id: (r.n_lines_, r.n_removed_, r.text) for r in line_dedup.dedup(table).collect()}
    assert got[1][2] == "a b\nc\nd\ne\nf" and got[2][2] == "x\ny" and got[3][2] == "\n \nz" and got[4][1:] == (4, "q") and got[5] == (0, 0, None) and got[7][1] == 0 and got[8][2] == ""
    con = duckdb.connect()
    frame = table.toPandas()
    con.register("documents", frame)
    want = {r[0]: r[1:] for r in con.sql("SELECT doc_id, n_lines, n_removed, text FROM (" + line_dedup.SQL.format(docs="documents") + ")").fetchall()}
    assert got == want


def test_token_counts(spark, docs, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    got = {r.doc_id: r.n_tokens for r in token_counts.of_documents(docs).collect()}
    assert got == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    lengths = [3, 0, 40_000, 0, 0, 600_000, 7]
    ids = np.concatenate([np.append(np.ones(n), 9) for n in lengths] + [np.ones(5)]).astype("<u4")
    ids.tofile(tmp_path / "a.bin")
    blocks = token_counts.read_files(spark, f"file://{tmp_path}/a.bin", width=4)
    out = sorted((r.ordinal, r.n_tokens, r.ended) for r in token_counts.counts(blocks, 9, 4).collect())
    assert out == [(i, n, True) for i, n in enumerate(lengths)] + [(7, 5, False)]


def test_rules(spark, docs):
    text = "one two three four five six seven eight " * 2 + "z\nA B\nA B\n#x $y"
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(300, text, None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in quality_rules.judge(table, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for r in table.collect():
        w, t = words(r.text), r.text or ""
        places = collections.defaultdict(list)
        for i in range(len(w) - 7):
            places[tuple(w[i : i + 8])].append(i)
        repeat = len({x for p in places.values() if len(p) > 1 for i in p for x in range(i, i + 8)})
        lines = [x for x in t.split("\n") if words(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat)
        assert g.base_failed == (len(w) < 20 or 100 * repeat > 30 * len(w)) and g.kept == (not g.base_failed)


def test_exact_bound():
    assert quality_rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    p = quality_rules.upper_bound(3, 50, 0.01)
    assert sum(math.comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) == pytest.approx(0.01)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.scratch.cut(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
    assert 0 < kept.select("doc_id").distinct().count() <= docs.count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.where("piece = 0").count() == kept.count()
