"""Words and word shingles of whole texts, found with vector operations on the UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D; as these are ASCII, no
multi-byte character is ever cut.  Texts are scanned in slices of about ``SLICE`` bytes, so
memory doesn't grow with the batch (one longer text is a slice of its own).

A word's hash is a polynomial over its bytes modulo 2**64, read off one running sum per slice,
then finished with a bit mixer.  A shingle's hash combines its words' hashes by position.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U = np.uint64
M64 = (1 << 64) - 1
RADIX = 0x9E3779B97F4A7C15 | 1
UNRADIX = pow(RADIX, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shift, multiply, shift)."""
    with np.errstate(over="ignore"):
        x = x + U((0x632BE59BD9B4E019 * (seed + 1)) & M64)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U))
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]  # A-Z as a-z
PLACES = mix(np.arange(101, 117, dtype=U)) | U(1)

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """run, which gives the memory that its task no longer needs back to the system: workers are kept for later tasks."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, SLICE + 1), U)
        out[0] = 1
        done = 1
        while done < len(out):  # doubling: the next run is the first times base**done
            k = min(done, len(out) - done)
            with np.errstate(over="ignore"):
                out[done : done + k] = out[:k] * U(pow(base, done, 1 << 64))
            done += k
        if len(out) > SLICE + 1:  # a longer text's powers are not kept
            return out
        _powers[base] = have = out
    return have


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts i..j-1: their bytes, each word's start and end there, and each text's first word (one more at the end)."""
    b = data[offsets[i] : offsets[j]]
    rel = offsets[i : j + 1] - offsets[i]
    word = np.empty(len(b) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(SPACE[b], out=word[1:-1])
    inner = rel[1:-1]
    inner = inner[(inner > 0) & (inner < len(b))]
    start = word[1:-1] & ~word[:-2]
    end = word[1:-1] & ~word[2:]
    start[inner] = word[1:-1][inner]
    end[inner - 1] = word[1:-1][inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return b, s, e, np.searchsorted(s, rel)


def word_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    up, down = _powers_of(RADIX, len(b) + 1), _powers_of(UNRADIX, len(b) + 1)
    run = np.zeros(len(b) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum((FOLDED if fold else BYTES)[b] * up[: len(b)], out=run[1:])
        return mix((run[e] - run[s]) * down[s])


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles (of the whole sequence where it has fewer words), and each text's first one."""
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(at[-1], U)
    with np.errstate(over="ignore"):
        if len(words) >= k:
            full = np.zeros(len(words) - k + 1, U)
            for p in range(k):
                full += words[p : len(words) - k + 1 + p] * PLACES[p]
        for size in range(1, k):  # texts of fewer words
            for t in np.flatnonzero(count == size):
                out[at[t]] = np.sum(words[first[t] : first[t] + size] * PLACES[:size], dtype=U) + U(size)
        long = np.flatnonzero(count >= k)
        if len(long):
            n = made[long]
            source = np.repeat(first[:-1][long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            target = np.repeat(at[:-1][long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out[target] = full[source]
    return mix(out, 7), at


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """Of each text in order: its set of k-word shingles as sorted distinct hashes."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        b, s, e, first = spans(data, offsets, i, j)
        h, at = shingle_hashes(word_hashes(b, s, e), first, k)
        for t in range(j - i):
            own = np.sort(h[at[t] : at[t + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def word_counts(column) -> np.ndarray:
    """Number of words of each text."""
    data, offsets = buffers(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in slices(offsets):
        out[i:j] = np.diff(spans(data, offsets, i, j)[3])
    return out
