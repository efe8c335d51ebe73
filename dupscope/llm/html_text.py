"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded so that a node and its descendants agree.

A page is parsed into a tree of block elements; every run of inline text in a block element
is a leaf.  Character references are decoded and white space inside a leaf becomes one space.

Method: each node (elements and leaves) gets features of its subtree (text density, link
density, paragraphs), of its attribute tokens and those of its ancestors, of its depth and its
siblings; boosted trees give the odds that it holds main text.  Decoding picks the labels of
greatest total log-likelihood among those where every ancestor of a chosen node is chosen:
the gain of a node is its log odds plus the gains of its children, and a node with a negative
gain drops its whole subtree.  The leaves that stay are joined in page order by ``\\n``.

The trees are trained here on pages generated from a seed (``TRAIN_PAGES`` of them, in many
layouts), whose main text is known; no page of the corpus is used.

Null or empty html gives an empty text.  Unclosed, misnested and cut-off markup is accepted.  Repeated rows are extracted each; a very long
page is held as its tree in one task, some hundred bytes a node.  An empty table gives an empty one.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting

TRAIN_PAGES, SEED = 300, 11
#: Pages scored together.
TOGETHER = 128

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of their own to show.
SILENT = frozenset("head script style noscript template title svg math iframe object canvas select option button textarea audio video datalist map".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr".split())
#: What a head may hold; any other start tag ends it.
HEAD = frozenset("head title meta link base style script noscript template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl div article section main td th form".split())
TAGS = {t: i for i, names in enumerate(("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "td th tr tbody thead", "blockquote pre figcaption figure", "article main", "section", "ul ol dl menu", "table", "nav", "header", "footer", "aside", "form fieldset", "html body"), 1) for t in names.split()}
TOKENS = [
    frozenset("article content main post entry story prose articlebody maincontent text body".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager".split()),
    frozenset("header masthead banner hero logo".split()),
    frozenset("footer foot bottom copyright legal colophon".split()),
    frozenset("sidebar aside widget related recommended popular trending rail complementary links".split()),
    frozenset("cookie cookies consent notice alert popup modal overlay newsletter subscribe gdpr message".split()),
    frozenset("ad ads adv advert advertisement sponsor sponsored promo promotion promoted".split()),
    frozenset("comment comments reply replies respond discussion disqus".split()),
    frozenset("form search login signup share social sharing follow".split()),
]


class Node:
    __slots__ = ("tag", "parent", "depth", "kinds", "text", "linked", "children", "leaf")

    def __init__(self, tag: str, parent: int, depth: int, kinds: int, leaf: bool = False):
        self.tag, self.parent, self.depth, self.kinds, self.leaf = tag, parent, depth, kinds, leaf
        self.text, self.linked, self.children = "", 0, 0


def _kinds(attributes: str) -> int:
    found = 0
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            for part in PARTS.findall((m[2] or m[3] or m[4] or "").lower()):
                for k, names in enumerate(TOKENS):
                    if part in names:
                        found |= 1 << k
    return found


def parse(page: str) -> list[Node]:
    """Block elements and text leaves in page order; node 0 is the root."""
    nodes = [Node("html", -1, 0, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; the second is the block node that text goes to
    run: list[str] = []
    linked = silent = links = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                at = stack[-1][1]
                leaf = Node("#text", at, nodes[at].depth + 1, 0, True)
                leaf.text, leaf.linked = text, min(linked, len(text))
                nodes.append(leaf)
                nodes[at].children += 1
            run.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal silent, links
        if any(t not in INLINE for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            silent -= t in SILENT
            links -= t == "a"
        del stack[k:]

    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.match(page, pos)
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not silent:
                    run.append(piece)
                    if links:
                        linked += len(piece)
            continue
        tag = name.lower()
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if k:
                close(k)
            continue
        if silent and tag not in HEAD and tag != "html":
            k = next((k for k in range(1, len(stack)) if stack[k][0] == "head"), 0)
            if k:
                close(k)
        if tag in ("html", "body"):
            flush()
            if tag == "body" and len(stack) > 1:
                close(1)
            nodes[0].kinds |= _kinds(m[3] or m[6] or "")
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        elif tag in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSED_BY[tag]:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table"):
                    break
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = stop.end() if stop else end
            continue
        if (m[3] or m[6] or "").endswith("/"):
            continue
        silent += tag in SILENT
        links += tag == "a"
        at = stack[-1][1]
        if tag not in INLINE:
            flush()
            if not silent:
                nodes.append(Node(tag, at, nodes[at].depth + 1, _kinds(m[3] or m[6] or "")))
                nodes[at].children += 1
                at = len(nodes) - 1
        stack.append((tag, at))
    flush()
    return nodes


FEATURES = 15 + 1 + 2 * len(TOKENS) + 18


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    leaf = np.array([x.leaf for x in nodes], float)
    size = np.array([len(x.text) for x in nodes], float)
    linked = np.array([x.linked for x in nodes], float)
    stops = np.array([x.text.count(".") + x.text.count(",") + x.text.count("。") if x.leaf else 0 for x in nodes], float)
    word = np.array([x.text.count(" ") + 1 if x.leaf else 0 for x in nodes], float)
    ends = np.array([x.leaf and x.text[-1:] in ".!?…。\"”)" for x in nodes], float)
    tag = np.array([TAGS.get(nodes[x.parent].tag if x.leaf else x.tag, 0) for x in nodes])
    own = np.array([nodes[x.parent].kinds if x.leaf else x.kinds for x in nodes])
    total, links, dots, leaves, blocks, paragraphs = size.copy(), linked.copy(), stops.copy(), leaf.copy(), np.ones(n), (tag == 1) * leaf
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        links[p] += links[i]
        dots[p] += dots[i]
        leaves[p] += leaves[i]
        blocks[p] += blocks[i]
        paragraphs[p] += paragraphs[i]
    above = np.zeros(n, np.int64)
    tags_above = np.zeros(n, np.int64)
    place, before = np.zeros(n), np.zeros(n, np.int64)
    for i in range(1, n):
        p = parent[i]
        above[i] = above[p] | own[p]
        tags_above[i] = tags_above[p] | 1 << tag[p]
        place[i] = before[p]
        before[p] += 1
    up = np.maximum(parent, 0)
    siblings = np.array([x.children for x in nodes], float)[up]
    cols = [(tag == k) * 1.0 for k in range(1, 16)] + [leaf]
    cols += [(own >> k & 1) * 1.0 for k in range(len(TOKENS))] + [(above >> k & 1) * 1.0 for k in range(len(TOKENS))]
    cols += [
        np.array([x.depth for x in nodes], float),
        np.log1p(total),
        total / blocks,
        links / np.maximum(total, 1),
        dots / np.maximum(total, 1) * 100,
        np.log1p(word),
        ends,
        np.log1p(paragraphs),
        siblings,
        place / np.maximum(siblings, 1),
        total / np.maximum(total[up], 1),
        paragraphs[up] / np.maximum(leaves[up], 1),
        links[up] / np.maximum(total[up], 1),
        np.log1p(total[up]),
        total / np.maximum(total[0], 1),
        (tags_above >> TAGS["article"] & 1) * 1.0,
        ((tags_above >> TAGS["nav"] | tags_above >> TAGS["header"] | tags_above >> TAGS["footer"] | tags_above >> TAGS["aside"] | tags_above >> TAGS["form"]) & 1) * 1.0,
        (tags_above >> TAGS["ul"] & 1) * 1.0,
    ]
    return np.stack(cols, 1)


def generated(rng: random.Random) -> tuple[str, set[str]]:
    """A page in a random layout and the texts of its main leaves."""
    main: set[str] = set()
    letters = rng.choice(["etaoinshrdlucm", "etaoinsréèàêçu", "enisratdhuläöüß", "eaosrnidlcñíóá"])

    def words(lo: int, hi: int) -> str:
        out = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 11))) for _ in range(rng.randint(lo, hi))]
        style = rng.random()
        if style < 0.06:
            out = [w + rng.choice(["###", "$$$", "***", "%%%"]) for w in out]
        elif style < 0.1:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.14:
            return " | ".join(out)
        for i in range(0, len(out), rng.randint(5, 14)):
            out[i] = out[i].capitalize()
            out[i - 1] += "." if i else ""
        return " ".join(out) + rng.choice([".", ".", ".", ".", ""])

    def kept(text: str) -> str:
        main.add(" ".join(text.split()))
        return text

    def attr(*names: str) -> str:
        name = rng.choice(names)
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {words(1, 1).strip(".")}"', f' class="c-{name}__inner"'])

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n))

    def menu() -> str:
        body = f"<ul>{links(rng.randint(2, 9))}</ul>"
        return rng.choice([f"<nav>{body}</nav>", f"<div{attr('menu', 'nav', 'navbar', 'breadcrumbs')}>{body}</div>", f"<header><nav>{body}</nav></header>"])

    def junk() -> str:
        text = words(3, 40)
        kind = rng.randint(0, 6)
        if kind == 0:
            return f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo')}>{rng.choice(['', '<p>'])}{text}</div>"
        if kind == 1:
            return f"<div{attr('cookie', 'notice', 'consent', 'newsletter', 'alert')}><p>{text}</p><button>ok</button></div>"
        if kind == 2:
            return rng.choice([f"<aside><h3>{words(1, 4)}</h3><p>{text}</p></aside>", f"<div{attr('sidebar', 'related', 'widget', 'popular')}><h3>{words(1, 4)}</h3><ul>{links(4)}</ul><p>{text}</p></div>"])
        if kind == 3:
            return f"<form{attr('search', 'login', 'form')}><label>{words(1, 4)}</label><input><p>{text}</p></form>"
        if kind == 4:
            many = "".join(f"<{t}{attr('comment')}><b>{words(1, 2)}</b><p>{words(4, 50)}</p></{t}>" for t in [rng.choice(["div", "li"])] * rng.randint(1, 5))
            return rng.choice([f"<section{attr('comments', 'discussion', 'respond')}><h2>{words(1, 3)}</h2>{many}</section>", f"<div{attr('comments', 'replies')}>{many}</div>"])
        if kind == 5:
            return f"<div{attr('share', 'social', 'follow')}><a href='#'>{words(1, 2)}</a> <a href='#'>{words(1, 2)}</a></div>"
        return f"<header{attr('header', 'masthead')}><div class='logo'>{words(1, 3)}</div><p>{words(2, 9)}</p></header>"

    def article() -> str:
        out = []
        if rng.random() < 0.85:
            title = kept(words(2, 14))
            out.append(f"<h1>{title}</h1>")
        for k in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            text, form = kept(words(*rng.choice([(1, 6), (5, 40), (20, 90)]))), rng.random()
            if form < 0.15 and k == 0:
                out.append(f"<p><b>{text}<br>")
            elif form < 0.7:
                out.append(f"<p>{text}" + "</p>" * (rng.random() < 0.9))
            elif form < 0.78:
                out.append(f"<h2>{text}</h2>")
            elif form < 0.86:
                out.append(f"<ul><li>{text}</li><li>{kept(words(3, 20))}</li></ul>")
            elif form < 0.92:
                out.append(f"<blockquote>{text}</blockquote>")
            else:
                out.append(f"<div>{text}</div>")
            if rng.random() < 0.15:
                out.append(junk())
        if not main:
            out.append(f"<p>{kept(words(5, 60))}</p>")
        body = "".join(out)
        return rng.choice([f"<article>{body}</article>"] * 3 + [f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div{attr('content', 'article', 'post', 'entry', 'story')}>{body}</div>", f"<div><section{attr('main', 'content')}>{body}</section></div>"])

    end = words(2, 25)
    foot = rng.choice([f"<footer>&copy; site.example &middot; {end}</footer>"] * 3 + [f"<div{attr('footer', 'copyright')}><p>{end}</p><ul>{links(3)}</ul></div>", f"<footer><p>{end}</p><ul>{links(4)}</ul></footer>", ""])
    parts = [menu() for _ in range(rng.randint(0, 2))] + [junk() for _ in range(rng.randint(0, 3))] + [article()] + [junk() for _ in range(rng.randint(0, 3))]
    inner = "".join(parts)
    if rng.random() < 0.3:
        inner = f"<div{rng.choice(['', ' id=wrapper', ' class=container'])}>{inner}</div>"
    page = f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><script>var a='<p>';</script></head><body>{inner}{foot}</body></html>"
    return (page if rng.random() < 0.9 else page[: -rng.randint(1, 30)]), main


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> tuple[float, list]:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, main = generated(rng)
        nodes = parse(page)
        y = np.array([float(x.leaf and x.text in main) for x in nodes])
        for i in range(len(nodes) - 1, 0, -1):
            y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
        xs.append(features(nodes))
        ys.append(y)
    return boosting.fit(np.concatenate(xs), np.concatenate(ys), rounds=40, depth=5, rate=0.3)


def decode(nodes: list[Node], odds: np.ndarray) -> list[str]:
    """Texts of the leaves chosen."""
    gain = odds.copy()
    gain[0] = max(gain[0], 0.0)
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    chosen = np.zeros(len(nodes), bool)
    chosen[0] = True
    for i in range(1, len(nodes)):
        chosen[i] = chosen[nodes[i].parent] and gain[i] > 0
    return [x.text for i, x in enumerate(nodes) if x.leaf and chosen[i]]


def texts(pages: list[str | None], model: tuple[float, list]) -> list[str]:
    out: list[str] = []
    for k in range(0, len(pages), TOGETHER):
        trees = [parse(p or "") for p in pages[k : k + TOGETHER]]
        odds = boosting.log_odds(model, np.concatenate([features(t) for t in trees]))
        at = np.cumsum([0, *map(len, trees)])
        out += ["\n".join(decode(t, odds[i:j])) for t, i, j in zip(trees, at[:-1], at[1:])]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                got = texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
