"""Array kernels over whole Arrow batches of text: words, word hashes, shingles.

All work on the UTF-8 bytes of many documents at once, so that the cost of a word is some tens of
nanoseconds and no Python object is made for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text hashed at a time; the tables of powers have this many entries.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
STEP = U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
IS_WORD_SPACED = ~_SPACE
IS_WORD_ALNUM = np.zeros(256, bool)
IS_WORD_ALNUM[0x30:0x3A] = IS_WORD_ALNUM[0x61:0x7B] = IS_WORD_ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each at least; kept by the process."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (BASE, inverse)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a multiply-xorshift finaliser)."""
    h = h ^ (h >> U(32))
    h = h * STEP
    h ^= h >> U(29)
    h *= U(0xA0761D6478BD642F)
    h ^= h >> U(32)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int):
    """Ranges [i, j) of documents of about ``size`` bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (n + 1).

    A word is a maximal run of bytes of the class within one document.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        turn = np.concatenate([[0], turn])
    starts, ends = turn[::2], turn[1::2]
    if len(ends) < len(starts):
        ends = np.concatenate([ends, [len(data)]])
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut - 1]]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial by prefix sums, mixed with the length."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(max(BLOCK, high - low) + 1)
        sums = np.zeros(high - low + 1, U)
        np.cumsum((data[low:high].astype(U) + U(1)) * power[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) * STEP
        i = j
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, in order, and their offsets (n + 1).

    A document with 1 to k - 1 words has its whole sequence as its one shingle.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    total, m = int(at[-1]), len(hashes)
    rolled = np.zeros(max(m, 1), U)
    for j in range(k):
        rolled *= STEP
        if m > j:
            rolled[: m - j] += hashes[j:]
    source = np.arange(total) - np.repeat(at[:-1] - first[:-1], count)
    out = rolled[source] if total else np.zeros(0, U)
    for d in np.flatnonzero((n > 0) & (n < k)):
        h = U(0)
        with np.errstate(over="ignore"):
            for x in hashes[first[d] : first[d + 1]]:
                h = h * STEP + x
            out[at[d]] = h + U(int(n[d])) * U(0x2545F4914F6CDD1D)
    return mix(out), at


def spaced_shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    """Per block of documents (i, j): shingle hashes and offsets for lower-cased words between white space."""
    for i, j in blocks(offsets, BLOCK):
        part = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = words(part, offsets[i : j + 1] - offsets[i], IS_WORD_SPACED)
        yield i, j, *shingles(word_hashes(part, starts, ends), first, k)
