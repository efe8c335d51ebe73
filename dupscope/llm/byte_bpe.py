"""Byte-level BPE ids of whole texts by a public rank file, and the bytes of ids.

Method: prefix dynamic programming.  A text is cut into pieces by the tokenizer's pattern.  For each byte prefix of a piece
one token is stored: the last token of that prefix's encoding.  It is the only token that ends the prefix and stands
rightly after the last token of the prefix before it, where two tokens stand rightly next to each other if merging their bytes alone gives
back just these two.  (Merges inside two neighbours happen in the same order alone and in a text, so an
encoding is right everywhere once it is right at each border.)  Ids are read backwards through the stored tokens.

The tokens that end at each byte come from one automaton over the vocabulary, so a piece takes time linear in its bytes, however long it
is.  As what is stored for a prefix never changes by what follows, an append goes on where the text ended, and
an edit computes anew only until as many stored tokens as the longest token has bytes agree with those before (:class:`Prefixes`).

Texts: null is empty, which has no ids.  Repeated rows are encoded each.  Very long texts are cut in runs of pieces; a piece
takes 5 bytes a byte.  An empty table gives an empty one.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, islice
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

DEFAULT = "byte_bpe_50k.tiktoken"
#: Pieces, and pairs of tokens, that a worker remembers; beyond, and for pieces of more bytes than SHORT, they are worked out each time.
REMEMBERED, PAIRS, SHORT = 200_000, 500_000, 64
#: Hashes told apart by the table of pieces seen once; pieces that share one are remembered a time earlier.
SEEN = 1 << 22
#: Pieces taken from a text at a time.
RUN = 1 << 17
#: Characters after a piece that its match may have looked at.
AHEAD = 3


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; a missing piece is encoded, and remembered from the second time on."""

    def __init__(self, encode: Callable[[bytes], array]):
        super().__init__()
        self.encode, self.seen = encode, bytearray(SEEN)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = np.array(self.encode(data), "<u4").tobytes()
        at = hash(piece) % SEEN
        if self.seen[at] and len(data) <= SHORT and len(self) < REMEMBERED:
            self[piece] = ids
        self.seen[at] = 1
        return ids


class Vocabulary:
    """Tokens of a file of ranks, and what may stand where."""

    def __init__(self, path: str, pattern: str | None = None):
        import ahocorasick
        import regex

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces = regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        self.suffixes = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), rank)
        self.suffixes.make_automaton()
        self._left: dict[int, list[int] | None] = {}
        self._right: dict[int, list[int] | None] = {}
        self.remembered = Pieces(self.piece)
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of a few bytes by merging, lowest rank first, then leftmost."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == len(self.tokens):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives the token; none if merging its bytes ends elsewhere, or if a part ranks above it."""
        data = self.tokens[token]
        for cut in range(1, len(data)):
            a, b = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
            if a is not None and b is not None and max(a, b) < token and self.merged(data[:cut]) == [a] and self.merged(data[cut:]) == [b] and self.stand(a, b, token):
                return a, b
        return None

    def spine(self, token: int, right: bool) -> list[int] | None:
        """The tokens that touch the token's right (or left) end while its bytes are merged, from one byte to the token itself."""
        known = self._right if right else self._left
        if token not in known:
            if len(self.tokens[token]) == 1:
                known[token] = [token]
            else:
                parts = self._parts(token)
                inner = parts and self.spine(parts[right], right)
                known[token] = [*inner, token] if inner else None
        return known[token]

    def alone(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        return self.spine(token, True) is not None or self.merged(self.tokens[token]) == [token]

    def stand(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether merging the bytes of a and b gives a, b (before the rank `below` is reached).

        The tokens at the border grow along a's right and b's left spine, by rank, left first; nothing may join them across.
        """
        x, y = self.spine(a, True), self.spine(b, False)
        none = len(self.tokens)
        end = none if below is None else below
        if x is None or y is None:  # ranks that don't rise as tokens grow
            return below is None and self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        i = j = 0
        while True:
            grown = x[i + 1] if i + 1 < len(x) else none
            other = y[j + 1] if j + 1 < len(y) else none
            across = self.ranks.get(self.tokens[x[i]] + self.tokens[y[j]], none)
            if across < min(grown, end) and across <= other:
                return False
            if grown == other == none:
                return True
            if grown <= other:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: array, to: int | None = None) -> None:
        """last, the stored tokens of data's first prefixes, grows to those of all prefixes (up to `to` bytes)."""
        at, to = len(last), len(data) if to is None else to
        begin = max(0, at + 1 - self.longest)
        tokens, pairs = self.tokens, self.pairs
        for end, token in self.suffixes.iter(data[begin:to].decode("latin-1")):
            n = begin + end + 1
            if n > at:
                start = n - len(tokens[token])
                if start:
                    pair = last[start - 1] << 32 | token
                    right = pairs.get(pair)
                    if right is None:
                        right = self.stand(last[start - 1], token)
                        if len(pairs) < PAIRS:
                            pairs[pair] = right
                else:
                    right = self.alone(token)
                if right:
                    last.append(token)
                    at = n

    def read(self, data: bytes, last: array) -> array:
        """Ids of a piece from its stored tokens; a piece that is a token is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return array("I", [whole])
        out, n = array("I"), len(data)
        while n:
            out.append(last[n - 1])
            n -= len(self.tokens[last[n - 1]])
        out.reverse()
        return out

    def piece(self, data: bytes) -> array:
        """Ids of a piece."""
        last = array("I")
        if data not in self.ranks:
            self.extend(data, last)
        return self.read(data, last)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(text) <= RUN:
            return b"".join(map(self.remembered.__getitem__, self.pieces.findall(text)))
        found, out = (m[0] for m in self.pieces.finditer(text)), bytearray()
        while run := list(islice(found, RUN)):
            out += b"".join(map(self.remembered.__getitem__, run))
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; ids that the file doesn't have raise."""
        at = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(self.tokens.__getitem__, at[i : i + RUN].tolist())) for i in range(0, len(at), RUN))


class Prefixes:
    """The encoding of one text, kept by prefixes so that it can be appended to and edited.

    ``computed`` counts the bytes whose stored tokens were computed so far.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text, self.computed = vocabulary, "", 0
        self.pieces: list[str] = []
        self.stored: list[array] = []
        self.append(text)

    def ids(self) -> list[int]:
        return [i for piece, last in zip(self.pieces, self.stored) for i in self.vocabulary.read(piece.encode(), last)]

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, new: str) -> None:
        """Characters start to end give way to others.  Pieces that ended well before stay; cutting stops at the first border after the edit that stood before."""
        ends = list(accumulate(map(len, self.pieces)))
        first = bisect_left(ends, start - AHEAD + 1)
        text, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        at, upto, made = ends[first - 1] if first else 0, first, []
        for match in self.vocabulary.pieces.finditer(text, at):
            made.append(match[0])
            at = match.end()
            while upto < len(ends) and ends[upto] < at - shift:
                upto += 1
            if at >= start + len(new) and upto < len(ends) and ends[upto] == at - shift:
                upto += 1
                break
        else:
            upto = len(self.pieces)
        old, held = self.pieces[first:upto], self.stored[first:upto]
        self.stored[first:upto] = [self._again(piece.encode(), *((old[k].encode(), held[k]) if k < len(old) else (b"", array("I")))) for k, piece in enumerate(made)]
        self.pieces[first:upto] = made
        self.text = text

    def _again(self, data: bytes, old: bytes, held: array) -> array:
        """The stored tokens of a piece from those of the piece in its place before: its common prefix's, then anew until they agree."""
        step = self.vocabulary.longest
        last = held[: len(commonprefix([data, old]))]
        tail = len(commonprefix([data[len(last) :][::-1], old[len(last) :][::-1]]))  # bytes from the end that are the same
        shift = len(old) - len(data)
        while len(last) < len(data):
            n = min(len(data), len(last) + step)
            self.computed += n - len(last)
            self.vocabulary.extend(data, last, n)
            if n - step >= len(data) - tail and min(n, n + shift) > step and last[n - step :] == held[n + shift - step : n + shift]:
                last += held[n + shift :]
        return last


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process and file."""
    return Vocabulary(path)


def _mapped(rows: DataFrame, source: str, into: str, work) -> DataFrame:
    """rows with a binary column made from another; a column of that name is replaced."""
    kept = [c for c in rows.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([work(x.as_py()) for x in batch.column(len(kept))], pa.large_binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made.cast(pa.binary())], [*kept, into])

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != into)
    return rows.select(*kept, F.col(source).alias("source_")).mapInArrow(words.tidy(run), f"{own}`{into}` binary")


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", into: str = "ids_") -> DataFrame:
    """docs with the ids of each whole text, as little-endian unsigned 32-bit integers."""
    path = tokenizer or default_path()
    return _mapped(docs, text, into, lambda x: vocabulary(path).encode(x or ""))


def decode(rows: DataFrame, tokenizer: str | None = None, ids: str = "ids_", into: str = "decoded_") -> DataFrame:
    """rows with the bytes of their ids; null ids have none."""
    path = tokenizer or default_path()
    return _mapped(rows, ids, into, lambda x: vocabulary(path).decode(x or b""))


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the bytes they decode to."""
    made = decode(encode(docs.select("doc_id", "text"), tokenizer).select("doc_id", "ids_"), tokenizer)
    return made.select("doc_id", (F.octet_length("ids_") / 4).cast("long").alias("n_tokens"), F.sha2("ids_", 256).alias("ids_sha256"), F.sha2("decoded_", 256).alias("decoded_sha256"))
