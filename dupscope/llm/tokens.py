"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words seen.

The tokenizer cuts at white space and never joins across it, so a text's ids are its
white-space-free chunks' ids in order.  Chunks are split at ASCII white space only; whatever
else a chunk holds goes to the tokenizer whole.  For chunks of Latin letters and closing ASCII
marks other than the apostrophe the normaliser and splitter have nothing to do, and the file's model is asked at
once, which gives the same ids (tests compare both) in less time.  Ids stay little-endian uint32 bytes until a text
is joined.

A worker remembers chunks and stems from the second time on: a table of bits tells which hashes it has seen, so that words
that come once (more than half of all) take no room.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

DEFAULT = "word_bpe_49k.json"
#: Chunks, stems (lower-cased letters of a chunk) and closing marks that a worker remembers; beyond, they are encoded each time.
CHUNKS, STEMS, MARKS = 150_000, 250_000, 1_000
#: Hashes told apart by the table of seen ones; words that share one are remembered a time earlier.
SEEN = 1 << 21
PLAIN = re.compile(r"([A-Za-zÀ-ɏ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


class Encoder(dict):
    """chunk (bytes) -> ids as little-endian uint32 bytes; a missing chunk is encoded."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.plain = model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and any(x["type"] == "ByteLevel" for x in spec["pre_tokenizer"].get("pretokenizers", []))
        self.merges = self.whole.model
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.seen, self.seen_stems = bytearray(SEEN), bytearray(SEEN)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the printable stand-ins of byte-level vocabularies
        extra = iter(range(256, 512))
        self.stand_in = [chr(b) if b in set(kept) else chr(next(extra)) for b in range(256)]

    def _slow(self, chunk: str) -> bytes:
        ids = self.whole.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge(self, stem: str) -> bytes:
        stands = stem if stem.isascii() else "".join([self.stand_in[b] for b in stem.encode()])
        ids = [x.id for x in self.merges.tokenize(stands)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        found = self.plain and PLAIN.match(text)
        if found:
            stem, mark = found[1].lower(), found[2]
            if not (stem.isascii() or stem.isalpha()):
                out = self._slow(text)
            else:
                out = self.stems.get(stem)
                if out is None:
                    out = self._merge(stem)
                    at = hash(stem) % SEEN
                    if self.seen_stems[at] and len(self.stems) < STEMS:
                        self.stems[stem] = out
                    self.seen_stems[at] = 1
                if mark:
                    tail = self.marks.get(mark)
                    if tail is None:
                        tail = self._slow(mark)
                        if len(self.marks) < MARKS:
                            self.marks[mark] = tail
                    out += tail
        else:
            out = self._slow(text)
        at = hash(chunk) % SEEN
        if self.seen[at] and len(self) < CHUNKS and len(chunk) < 64:
            self[chunk] = out
        self.seen[at] = 1
        return out

    def text(self, data: bytes) -> bytes:
        """All ids of a text given as UTF-8."""
        return b"".join(map(self.__getitem__, data.split()))


@lru_cache(maxsize=2)
def encoder(path: str, literal: bool = False) -> Encoder:
    """One for each worker process and file; literal: special tokens' strings in a text are ordinary text."""
    made = Encoder(path)
    made.whole.encode_special_tokens = literal
    return made
