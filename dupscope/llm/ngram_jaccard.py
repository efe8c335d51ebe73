"""N-gram Jaccard join: all texts whose sets of k-word shingles have a Jaccard similarity >= t.

Method: signature trees.  A text's signature is a bitmap of its shingles and the size of its set.
A tree holds, for each node, the OR of the bitmaps and the range of sizes below it; two trees
are traversed together, and two nodes are opened only while the largest overlap that their
bitmaps and sizes allow reaches ``t / (1 + t) * (size_a + size_b)``.  Texts of a tree are ordered by
content (their smallest shingles), one tree for each class of sizes, and bitmaps are as wide as
the class needs.  Pairs that reach the leaves are compared exactly at once, and nodes
whose texts are all connected already are not opened again, so a tree of m texts returns fewer than m links
and never a list of pairs.

How texts meet in a tree, without losing a pair:

1. Texts with equal shingle sets are one class (128-bit digest and size); its smallest doc_id
   stands for it.  Copies are never expanded.
2. In any order that holds for all texts, similar texts share l of the first ``n - ceil(t n) + l``
   shingles (l = n / 10 here).  Texts of which fewer are found in any other text are out.  The order
   is (common, hash); common are the at most ``COMMON`` shingle cells that hold the largest shares of all
   shingles.  A wrong order costs time, never pairs.
3. The m shingles that a text still shares are ordered by how many texts have them.  As similar texts share l of
   them, they share one of the first ``m - l + 1``, the rarest.  Texts that share one of these are
   neighbours, and what hangs together is a neighbourhood.  Only shingles and ids are shuffled up to here; after that a text's
   words go to the place of its neighbourhood.
4. A neighbourhood of up to ``BLOCK`` shingles is one tree.  A larger one is cut by the smallest shared shingle (and
   by hash, where that is still too large).  Then its groups around one shingle, or all of it as one group where that
   copies fewer texts, meet through one text of each component, as long as that links any, and
   at last in block pairs, where they are still unconnected; texts of a group's largest component only meet those outside it.

Null, empty texts: an empty set, linked with nothing.  Rows with a null doc_id keep a row with
a null component.  Rows that share a doc_id are one document: their component holds what any of their
texts is linked with.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, scratch, words

#: Cells of shingles, and how many of them at most are called common (a proven bound: each holds 1 / COMMON of all shingles or more).
CELLS, COMMON = 1 << 24, 1 << 18
#: A task reports a cell when so many texts of one block of so many shingles have it.
COMMON_IN_BLOCK, BLOCK_SHINGLES = 8, 2_000_000
#: Shingles of one tree (8 bytes each, and up to as much again for bitmaps).
BLOCK = 3_000_000
LEAF, FAN = 4, 4
#: Node pairs opened at once.
OPEN = 2048
#: Bits of the filter of doc_ids in front of the join with texts: 2 MB; beyond its size it lets more rows through.
FILTER = 1 << 24


def _needs(t: tuple[int, int], n):
    """Smallest overlap of a set of n with any similar set."""
    return -(-t[0] * n // t[1])


def _digest(own: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([np.sum(words.mix(own, 3), dtype=np.uint64), np.bitwise_xor.reduce(words.mix(own, 5)) if len(own) else 0], np.uint64).tobytes()


# -- classes and keys ---------------------------------------------------------------------------


def survey(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), digest of each row; and rows (cell, times) of shingles seen often within a block."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("cell", pa.int64()), ("times", pa.int64())])

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, times = np.unique(np.concatenate(held) >> words.U(40), return_counts=True)
        cell, times = cell[times >= COMMON_IN_BLOCK].astype(np.int64), times[times >= COMMON_IN_BLOCK]
        none = pa.nulls(len(cell))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(cell), pa.array(times, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            n, digests = [], []
            for own in words.shingle_sets(batch.column(1), k):
                n.append(len(own))
                digests.append(_digest(own))
                held.append(own)
                total += len(own)
                if total >= BLOCK_SHINGLES:
                    yield often(held)
                    held, total = [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), none, none], schema=schema)
        if held:
            yield often(held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words.tidy(run), "doc_id long, n long, digest binary, cell long, times long")


def common_cells(seen: DataFrame) -> np.ndarray:
    """Of a written survey: which cells are common.  At most COMMON rows reach the driver, whatever the corpus."""
    total = seen.agg(F.sum("n")).first()[0] or 0
    got = seen.where("cell is not null").groupBy("cell").agg(F.sum("times").alias("times")).where(F.col("times") >= max(COMMON_IN_BLOCK, -(-total // COMMON))).select("cell").toArrow()
    out = np.zeros(CELLS, bool)
    out[got["cell"].to_numpy()] = True
    return out


def prefixes(docs: DataFrame, k: int, t: tuple[int, int], common: np.ndarray) -> DataFrame:
    """doc_id, n, digest, prefix (n - ceil(t n) + l shingles, the first in the common order) of texts with words."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(held.value).view(bool)
        for batch in batches:
            n, digests, prefix = [], [], []
            for own in words.shingle_sets(batch.column(1), k):
                n.append(len(own))
                digests.append(_digest(own))
                late = hot[(own >> words.U(40)).astype(np.int64)]
                p = len(own) - _needs(t, len(own)) + max(1, len(own) // 10)
                prefix.append((np.concatenate([own[~late], own[late]])[:p] if late.any() else own[:p]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "n", "digest", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(words.tidy(run), "doc_id long, n long, digest binary, prefix binary").where("n > 0 and doc_id is not null")


def _longs(column) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number of values of each row) of a binary column of 8-byte values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint64), np.diff(offsets) // 8


def shared(chosen: DataFrame, t: tuple[int, int]) -> DataFrame:
    """chosen (doc_id, n, prefix) -> key, doc_id, n: the shingles of the prefixes that several texts have.

    Keys travel packed: one row for each bucket of a batch, with the keys and the texts they belong to.
    """
    parts = scratch.partitions(chosen.sparkSession)
    buckets = 2 * parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, count = _longs(batch.column(2))
            doc = np.repeat(np.arange(len(ids)), count)
            bucket = ((keys >> words.U(32)) * words.U(buckets) >> words.U(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cut)):
                part = order[cut[b] : cut[b + 1]]
                d = doc[part]
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                rows.append((b, ids[d[first]].tobytes(), n[d[first]].tobytes(), np.diff(np.append(first, len(d))).astype("<u4").tobytes(), keys[part].tobytes()))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "docs", "ns", "counts", "keys"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in sorted_groups(batches, ("bucket",)):
            for p, q in zip(at[:-1], at[1:]):
                rows = table.slice(p, q - p).to_pylist()
                keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
                counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows])
                order = np.argsort(keys, kind="stable")
                same = keys[order][1:] == keys[order][:-1]
                take = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
                ids, n = (np.repeat(np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]), counts)[take] for c in ("docs", "ns"))
                yield pa.RecordBatch.from_arrays([pa.array(keys[take].view(np.int64)), pa.array(ids), pa.array(n)], ["key", "doc_id", "n"])

    packed = chosen.select("doc_id", "n", "prefix").mapInArrow(words.tidy(pack), "bucket int, docs binary, ns binary, counts binary, keys binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(words.tidy(found), "key long, doc_id long, n long")


def rarest(keys: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Of written keys (key, doc_id, n): for each text that shares enough, the rarest of which it must share one with any similar text."""
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * t[0] / t[1]) / 10))
    enough = keys.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least).select("doc_id", "n")
    live = keys.join(enough, ["doc_id", "n"], "left_semi")
    often = live.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    own = Window.partitionBy("doc_id", "n")  # at most a text's own shingles
    ranked = live.join(often, "key").withColumn("rank", F.row_number().over(own.orderBy("often", "key"))).withColumn("m", F.count(F.lit(1)).over(own))
    return ranked.where((F.col("m") >= least) & (F.col("rank") <= F.col("m") - least + 1)).select("key", "doc_id", "n")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of rows sorted by integer keys: tables of whole groups, with the groups' bounds.  A group waits until it ends."""
    held: list[pa.RecordBatch] = []

    def bounds(x: pa.Table) -> np.ndarray:
        new = np.zeros(len(x), bool)
        for c in keys:
            v = x.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        x = pa.Table.from_batches(held)
        cuts = bounds(x)
        if len(cuts):
            yield x.slice(0, cuts[-1]), np.concatenate([[0], cuts])
            held = x.slice(cuts[-1]).to_batches()
    if held:
        x = pa.Table.from_batches(held)
        yield x, np.concatenate([[0], bounds(x), [len(x)]])


# -- signature trees ----------------------------------------------------------------------------


class Links:
    """Which texts are connected; ``made`` are the links found, as pairs of indexes."""

    def __init__(self, start: np.ndarray):
        self.top, self.made, self.changed = start.copy(), [], True

    def find(self, i: int) -> int:
        top = self.top
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def add(self, i: int, j: int) -> None:
        p, q = self.find(i), self.find(j)
        self.top[max(p, q)] = min(p, q)
        self.made.append((i, j))
        self.changed = True

    def roots(self) -> np.ndarray:
        while True:
            up = self.top[self.top]
            if np.array_equal(up, self.top):
                return up
            self.top = up


class Tree:
    """Texts (indexes into sets, in the order of their content); each level holds bitmaps, sizes and slack of its nodes."""

    def __init__(self, at: np.ndarray, sets: list[np.ndarray], width: int):
        self.at, self.width = at, width
        n = np.array([len(sets[i]) for i in at], np.int64)
        bits = np.concatenate([self._bitmaps([sets[i] for i in at[p : p + 64]], width) for p in range(0, len(at), 64)])
        level = (bits, n, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64))
        self.levels, self.fans, self.cuts, fan = [level], [], [], LEAF
        while len(level[1]) > 1:
            cut = np.arange(0, len(level[1]), fan)
            level = (np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
            self.levels.append(level)
            self.fans.append(fan)
            self.cuts.append(cut)
            fan = FAN
        self.spans: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
        bits = np.zeros((len(sets), width), np.uint8)
        bits[np.repeat(np.arange(len(sets)), list(map(len, sets))), (np.concatenate(sets) & words.U(width - 1)).astype(np.int64)] = 1
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def mark(self, roots: np.ndarray) -> None:
        """The range of components below each node."""
        lo = hi = roots[self.at]
        self.spans = [(lo, hi)]
        for cut in self.cuts:
            lo, hi = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.spans.append((lo, hi))

    def narrowed(self, width: int) -> list[np.ndarray]:
        """The levels' bitmaps folded to a width."""
        return [x[0].reshape(len(x[0]), -1, width // 64) for x in self.levels] if width < self.width else [x[0][:, None] for x in self.levels]

    def children(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes of level depth: (index into nodes, child of level depth - 1)."""
        fan = self.fans[depth - 1]
        child = nodes[:, None] * fan + np.arange(fan)
        which = np.broadcast_to(np.arange(len(nodes))[:, None], child.shape)
        ok = child < len(self.levels[depth - 1][1])
        return which[ok], child[ok]


def similar(p: np.ndarray, q: np.ndarray, t: tuple[int, int]) -> bool:
    """Of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p) or len(p) * t[1] < len(q) * t[0]:
        return False
    at = np.searchsorted(q, p)
    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return t[1] * both >= t[0] * (len(p) + len(q) - both)


def traverse(x: Tree, y: Tree, sets: list[np.ndarray], t: tuple[int, int], links: Links) -> dict[str, int]:
    """Links all similar texts of two trees (or of one, given twice) that aren't connected yet.

    Returns what was opened and compared: node pairs met above the leaves, those opened, and text pairs compared.
    """
    same, width = x is y, min(x.width, y.width)
    bx, by = x.narrowed(width), y.narrowed(width)
    done = {"met": 0, "opened": 0, "compared": 0}
    todo = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    links.changed = True
    most = max(32, min(OPEN, (1 << 25) // width))
    while todo:
        dx, dy, a, b = todo.pop()
        if len(a) > most:
            todo.append((dx, dy, a[most:], b[most:]))
            a, b = a[:most], b[:most]
        if links.changed:
            roots = links.roots()
            x.mark(roots)
            y.mark(roots)
            links.changed = False
        inner = bool(dx or dy)
        done["met"] += len(a) * inner
        (_, na, ma, sa), (_, nb, mb, sb) = x.levels[dx], y.levels[dy]
        (la, ha), (lb, hb) = x.spans[dx], y.spans[dy]
        ok = ~((la[a] == ha[a]) & (lb[b] == hb[b]) & (la[a] == lb[b])) & (ma[a] * t[1] >= nb[b] * t[0]) & (mb[b] * t[1] >= na[a] * t[0])
        if same and dx == dy:
            ok &= a <= b if inner else a < b
        a, b = a[ok], b[ok]
        both = np.bitwise_count(np.bitwise_or.reduce(bx[dx][a], 1) & np.bitwise_or.reduce(by[dy][b], 1)).sum(1, dtype=np.int64) + np.minimum(sa[a], sb[b])
        ok = np.minimum(both, np.minimum(ma[a], mb[b])) * (t[0] + t[1]) >= t[0] * (na[a] + nb[b])
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if not inner:
            for i, j in zip(x.at[a].tolist(), y.at[b].tolist()):
                if links.find(i) != links.find(j):
                    done["compared"] += 1
                    if similar(sets[i], sets[j], t):
                        links.add(i, j)
            continue
        done["opened"] += len(a)
        if dx >= dy:
            which, a = x.children(dx, a)
            todo.append((dx - 1, dy, a, b[which]))
        else:
            which, b = y.children(dy, b)
            todo.append((dx, dy - 1, a[which], b))
    return done


def connect(sets: list[np.ndarray], comp: np.ndarray, t: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (pairs of indexes) that connect all similar sets; comp: indexes with equal numbers are connected already."""
    _, first, back = np.unique(comp, return_index=True, return_inverse=True)
    links = Links(first[back].astype(np.int64))
    if len(sets) == 2:  # both are leaves
        return [(0, 1)] if comp[0] != comp[1] and similar(*sets, t) else []
    n = np.array([len(s) for s in sets], np.int64)
    bounds = [1]  # sizes whose classes are more than one apart are never similar
    while bounds[-1] <= n.max():
        bounds.append(bounds[-1] * t[1] // t[0] + 1)
    size = np.searchsorted(bounds, n, "right")
    head = [np.array([s[k] if len(s) > k else 0 for s in sets], np.uint64) for k in (0, 1)]
    order = np.lexsort((head[1], head[0], size))
    cut = np.flatnonzero(np.concatenate([[True], size[order][1:] != size[order][:-1], [True]]))
    before = None
    for p, q in zip(cut[:-1], cut[1:]):
        kind = int(size[order[p]])
        tree = Tree(order[p:q], sets, max(256, 1 << (4 * bounds[kind] - 1).bit_length()))
        traverse(tree, tree, sets, t, links)
        if before and before[0] == kind - 1:
            traverse(before[1], tree, sets, t, links)
        before = (kind, tree)
    return links.made


def match(dealt: DataFrame, texts: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """dealt (unit, salt, doc_id, comp), texts (doc_id, text) -> links a, b: one tree of texts for each unit and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in sorted_groups(batches, ("unit", "salt")):
            ids, comp = table.column("doc_id").to_numpy(), table.column("comp").to_numpy()
            _, offsets = words.buffers(table.column("text"))
            p = 0
            while p < len(at) - 1:  # groups of a few MB of text together
                q = max(p + 1, int(np.searchsorted(offsets[at], offsets[at[p]] + (1 << 22), "right")) - 1)
                sets = list(words.shingle_sets(table.column("text").slice(at[p], at[q] - at[p]), k))
                a, b = [], []
                for u, v in zip(at[p:q], at[p + 1 : q + 1]):
                    for i, j in connect(sets[u - at[p] : v - at[p]], comp[u:v], t) if v - u > 1 else ():
                        a.append(ids[u + i])
                        b.append(ids[u + j])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                p = q

    rows = dealt.join(texts, "doc_id").select("unit", "salt", "doc_id", "comp", "text")
    return rows.repartition(scratch.partitions(dealt.sparkSession), "unit", "salt").sortWithinPartitions("unit", "salt", "doc_id").mapInArrow(words.tidy(run), "a long, b long")


# -- the join -----------------------------------------------------------------------------------


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of the wanted ids, each text once; a filter of fixed size keeps most others from the shuffle."""

    def cells(ids: np.ndarray) -> np.ndarray:
        return (words.mix(ids.view(np.uint64), 9) & words.U(FILTER - 1)).astype(np.int64)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(cells(batch.column(0).to_numpy()))
            if len(found):
                page, at = np.unique(found >> 6, return_index=True)
                word = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (found & 63).astype(np.uint64)), at).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(page), pa.array(word)], ["page", "word"])

    got = wanted.select("doc_id").mapInArrow(pages, "page long, word long").groupBy("page").agg(F.bit_or("word").alias("word")).toArrow()  # FILTER / 64 rows at most
    bits = np.zeros(FILTER // 64, np.int64)
    bits[got["page"].to_numpy()] = got["word"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells(batch.column(0).to_numpy())
            yield batch.filter(pa.array((held.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).view(bool)))

    some = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null").mapInArrow(passing, "doc_id long, text string")
    return some.join(wanted.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).drop("h")


def _blocks(shingles: Column, parts: int = 1) -> Column:
    """How many blocks, each of so many parts of BLOCK."""
    return F.ceil(shingles / (BLOCK // parts)).cast("long")


def _own(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), blocks)


def _with_components(members: DataFrame, links: DataFrame) -> DataFrame:
    found = graph.components(links).select(F.col("node").alias("doc_id"), "component")
    return members.join(found, "doc_id", "left").select(*members.columns, F.coalesce("component", "doc_id").alias("comp"))


def _rest(members: DataFrame, links: DataFrame, texts: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """All links, given those found in blocks: groups (gid, doc_id, n) that still span components meet as a whole."""
    while True:
        placed = scratch.cut(_with_components(members, links), "placed")
        apart = placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("gid")
        placed = scratch.cut(placed.join(apart, "gid", "left_semi"), "apart")
        one = placed.groupBy("gid", "comp").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("lead"), F.sum("n").alias("all"))
        leads = one.select("gid", "comp", "lead.*", "all")
        total = leads.groupBy("gid").agg(F.sum("n").alias("total"), F.sum("all").alias("all")).where("total * 2 <= all").drop("all")  # else they would be most of the group
        dealt = leads.join(total, "gid").select(F.col("gid").alias("unit"), _own(_blocks(F.col("total"))).alias("salt"), "doc_id", "comp")
        more = scratch.cut(match(dealt, texts, k, t), "links")
        if more.isEmpty():
            break
        links = scratch.cut(links.union(more), "links")

    sums = placed.groupBy("gid", "comp").agg(F.sum("n").alias("n"))
    core = sums.groupBy("gid").agg(F.max(F.struct("n", "comp")).alias("core"), F.sum("n").alias("total"))
    sized = core.select("gid", F.col("core.comp").alias("core"), _blocks(F.col("total") - F.col("core.n"), 2).alias("outer"), _blocks(F.col("core.n"), 2).alias("inner"))
    inside = F.col("comp") == F.col("core")
    own = F.when(inside, F.col("outer") + _own(F.col("inner"))).otherwise(_own(F.col("outer")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1))
    pairs = placed.join(sized, "gid").withColumn("own", own).withColumn("other", others)
    dealt = pairs.select(F.col("gid").alias("unit"), (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("salt"), "doc_id", "comp")
    return links.union(match(dealt, texts, k, t))


def join(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id; threshold is a fraction."""
    t = threshold
    seen = scratch.cut(survey(docs, k), "survey")
    rows = seen.where("digest is not null").select("doc_id", "n", "digest")
    filled = rows.where("n > 0 and doc_id is not null")
    classes = scratch.cut(filled.groupBy("digest", "n").agg(F.min("doc_id").alias("rep")), "classes")
    ids = filled.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    named = filled.join(ids, "doc_id", "left_semi").join(classes, ["digest", "n"]).select("doc_id", "rep").distinct()
    alike = named.join(named.groupBy("doc_id").agg(F.min("rep").alias("lead")), "doc_id").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))  # texts of one doc_id

    chosen = prefixes(docs, k, t, common_cells(seen)).groupBy("digest", "n").agg(F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"))
    keys = scratch.cut(shared(chosen, t), "keys")
    early = scratch.cut(rarest(keys, t), "early")
    scratch.drop(keys)
    x, y = F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")
    groups = early.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("lead"), x, y).where("size > 1")
    lists = groups.groupBy("size", "lead", "x", "y").agg(F.min("key").alias("key"))  # shingles with the same texts are one group
    members = scratch.cut(early.join(lists.select("key", "lead"), "key").select(F.col("key").alias("gid"), "lead", "doc_id", "n"), "members")

    hoods = graph.components(members.where("lead < doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()).withColumnRenamed("node", "doc_id")
    homes = members.groupBy("doc_id").agg(F.min("gid").alias("home"), F.max("n").alias("n"))
    sized = scratch.cut(homes.join(hoods, "doc_id"), "hoods")
    large = scratch.cut(sized.groupBy("component").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK), "large")
    split = sized.join(large, "component", "left_semi")
    salts = split.groupBy("component", "home").agg(F.sum("n").alias("total"))
    dealt = (
        sized.join(large, "component", "left_anti")
        .select(F.col("component").alias("unit"), F.lit(-1).cast("long").alias("salt"), "doc_id", F.col("doc_id").alias("comp"))
        .union(split.join(salts, ["component", "home"]).select("home", _own(_blocks(F.col("total"))), "doc_id", "doc_id"))
    )
    texts = scratch.cut(_texts(docs, sized), "texts")
    links = scratch.cut(match(dealt, texts, k, t), "links")
    if not large.isEmpty():
        # A neighbourhood's groups around its shingles, or all of it as one group: what copies fewer texts.
        groups = members.join(split.select("doc_id", "component"), "doc_id").groupBy("component").agg(F.sum("n").alias("copied"))
        whole = groups.join(large, "component").where(F.col("total") * _blocks(F.col("total"), 2) <= F.col("copied")).select("component")
        at_once = split.join(whole, "component", "left_semi").select(F.col("component").alias("gid"), "doc_id", "n")
        by_shingle = members.join(split.join(whole, "component", "left_anti").select("doc_id"), "doc_id", "left_semi").select("gid", "doc_id", "n")
        wide = scratch.cut(at_once.union(by_shingle), "wide")
        links = _rest(wide, links, texts, k, t)
    final = graph.components(links.union(alike))

    labelled = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", F.when(F.expr("n > 0 and doc_id is not null"), F.col("digest")).alias("digest")).join(labelled, ["digest", "n"], "left")
    for done in (early, members, sized, texts):
        scratch.drop(done)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """The documents with one of each group: the one whose doc_id is smallest.  Rows with a null doc_id stay."""
    gone = join(docs, k, threshold).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
