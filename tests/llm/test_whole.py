"""Rows that the operators must treat whole and apart: null and shared ids, repeats."""

import collections
import random

import numpy as np

from dupscope.llm import html_text, line_dedup, mixing, url_filter


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    seen, own = "p\nq\nr", "u\nv\nw"
    rows = [(1, f"0\n{seen}"), (9, f"{seen}\nx"), (9, own), (9, f"{own}\nk\nl\nm"), (None, "a\nb\nc"), (None, f"h\n{own}"), (None, "d\ne\nf\ng"), (None, "h\na\nb\nc"), (None, None), (None, "d\ne\nf\ng")]
    out = [(r.doc_id, r.n_removed_, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, 0, f"0\n{seen}"), (9, 3, "x"), (9, 3, ""), (9, 3, "k\nl\nm"), (None, 0, f"h\n{own}"), (None, 0, "d\ne\nf\ng"), (None, 0, "d\ne\nf\ng"), (None, 0, None)]
    first = ([(None, 0, "a\nb\nc"), (None, 3, "h")], [(None, 3, ""), (None, 0, "h\na\nb\nc")])  # by hash
    assert sorted(map(repr, out)) in [sorted(map(repr, want + x)) for x in first]


def test_mix_emits_the_times_of_repeated_rows(spark):
    rows = [(1, "a b c", "s0", "en")] * 1000 + [(2, "a b", "s1", "en")] * 400 + [(2, "a b", "s1", "de")] * 3 + [(None, "k", "s2", None)] * 500 + [(0, "k", "s2", None), (0, None, "s2", None), (0, "s2", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    units, out = mixing.taken(docs).collect(), collections.Counter(map(tuple, mixing.mixed(docs).collect()))
    target, size = {}, collections.Counter()
    for r in units:
        target[r.source] = r.target
    for (_, text, source, _), n in out.items():
        size[source] += n * len((text or "").split())
    assert any(0 < t / s % 1 < 0.5 for t, s in ((r.target, r.source_size) for r in units))
    assert all(abs(size[s] - target[s]) <= 3 for s in target)
    assert sum(out.values()) == sum(r.times for r in units)
    assert all(n <= 3 * rows.count(x) for x, n in out.items()) and set(out) <= set(rows)


def test_html_head_ends_at_the_first_tag_of_the_body():
    leaves = lambda page: [x.text for x in html_text.parse(page) if x.leaf]
    head = "<html><head><title>t</title><meta charset=x><script>var a='<p>';</script><link href=y><style>p{}</style>"
    for end in ("", "</head>", "</head><body>", "<body>"):
        assert leaves(f"{head}{end}<article><p>text") == ["text"]
    assert leaves("<head><title>t</title><p>one</head><p>two") == ["one", "two"]
    assert leaves("<head><head><title>t</title><div>one<select><option>no</select>") == ["one"]


def test_urls_that_differ_by_suffix_are_told_apart(spark):
    urls = [f"http://h{i % 10}{i // 10 % 10}{i // 100}.{('biz', 'edu', 'gov')[i % 3]}/a" for i in range(600)]
    labelled = spark.createDataFrame([(u, int(".biz/" in u)) for u in urls], "url string, bad int")
    pages = spark.createDataFrame([(0, "http://h999.biz/a"), (1, "http://h999.edu/a"), (2, "http://h999.gov/a")], "page_id long, url string")
    out = {r.page_id: r.verdict for r in url_filter.judge(pages, labelled).collect()}
    assert out == {0: "block", 1: "allow", 2: "allow"}


def test_chunks_with_closing_marks_have_the_tokenizer_ids():
    from tokenizers import Tokenizer

    from dupscope.llm import tokens

    rng = random.Random(3)
    chunks = ["".join(rng.choices("abcXYZéÉßæſ×÷İı", k=rng.randint(1, 5))) + "".join(rng.choices("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", k=rng.randint(0, 4))) for _ in range(3000)]
    chunks += ["<|endoftext|>", "a<|endoftext|>", "endoftext|>", "a<|", "it's", "a's!", "x'", "a_b", "%%%"]
    tok = Tokenizer.from_file(tokens.default_path())
    enc = tokens.Encoder(tokens.default_path())
    for chunk in chunks * 3:  # met, seen again, remembered
        ids = tok.encode(chunk, add_special_tokens=False).ids
        assert enc[chunk.encode()] == np.array(ids, "<u4").tobytes()
    assert len(enc) > 2500 and len(enc.marks) <= tokens.MARKS
