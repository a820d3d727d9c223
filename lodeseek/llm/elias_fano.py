"""Elias-Fano sequences in memory-mapped arrays, with successor search of many keys at once."""

from __future__ import annotations

import tempfile

import numpy as np

U = np.uint64
#: When more than one key is asked for so many elements, the sequence is read through once instead.
MANY = 16
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def mapped(array: np.ndarray) -> np.ndarray:
    """The array as a read-only map of an unnamed file, which goes with the process."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as f:
        f.write(memoryview(np.ascontiguousarray(array)).cast("B"))
        f.flush()
        return np.memmap(f, array.dtype, "r", shape=array.shape)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` <= 63 bits one after another in 64-bit words (one word to spare)."""
    n = len(values)
    words = np.zeros((n * width >> 6) + 2, U)
    if not n or not width:
        return words
    at = np.arange(n, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U)
    # of each run of values that begin in one word the OR is a sum, for their bits are disjoint
    np.add.at(words, word, values << shift)
    over = (at & 63) + width > 64
    np.add.at(words, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return words


def unpack(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), U)
    at = index * width
    word, shift = at >> 6, (at & 63).astype(U)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return (low | high) & U((1 << width) - 1)


def _parts(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Width of the low bits, the last high part, the low bits and the unary part."""
    n = len(values)
    width = min(62, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1))
    high = (values >> U(width)).astype(np.int64)
    last = int(high[-1]) if n else 0
    bits = np.zeros(((n + last + 2) // 8 + 1) * 8, np.uint8)
    bits[high + np.arange(n)] = 1
    return width, last, pack(values & U((1 << width) - 1), width), np.packbits(bits, bitorder="little")


def _all(n: int, width: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Every element, in order."""
    place = np.arange(n, dtype=np.int64)
    return ((np.flatnonzero(np.unpackbits(high, bitorder="little")) - place).astype(U) << U(width)) | unpack(low, place, width)


def encoded(values: np.ndarray, universe: int) -> bytes:
    """The sequence as bytes, for what tasks hand to each other."""
    width, _, low, high = _parts(values, universe)
    return np.array([len(values), width], np.int64).tobytes() + low[:-1].tobytes() + high.tobytes()


def decoded(blob: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    words = (n * width >> 6) + 1
    low = np.append(np.frombuffer(blob, U, words, 16), U(0))
    return _all(n, width, low, np.frombuffer(blob, np.uint8, -1, 16 + 8 * words))


class EliasFano:
    """A sequence of 64-bit numbers that never falls: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.width, self.last, low, packed = _parts(values, universe)
        self.low, self.high = mapped(low), mapped(packed)
        # zeros before each byte of the unary part: the directory for select
        self.zeros = mapped(np.concatenate([[0], np.cumsum(8 - _ONES[packed])]))

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th zeros, counted from 0."""
        byte = np.searchsorted(self.zeros, k, side="right") - 1
        rest, value = k - self.zeros[byte], self.high[byte].astype(np.int64)
        place = np.zeros(len(k), np.int64)
        found = np.zeros(len(k), bool)
        for bit in range(8):
            zero = ((value >> bit) & 1) == 0
            hit = zero & (rest == 0) & ~found
            place[hit] = bit
            found |= hit
            rest = rest - (zero & ~found)
        return byte * 8 + place

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """For each key the index of the first element that is not less (n if there is none)."""
        if not self.n:
            return np.zeros(len(keys), np.int64)
        if len(keys) > self.n // MANY:
            return np.searchsorted(_all(self.n, self.width, self.low, self.high), keys)
        h = (keys >> U(self.width)).astype(np.int64)
        beyond = h > self.last
        h = np.minimum(h, self.last)
        end = self._select_zero(h) - h
        start = np.where(h > 0, self._select_zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        start = np.where(h > 0, start, 0)
        want = keys & U((1 << self.width) - 1)
        low, high = start.copy(), end.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = unpack(self.low, middle, self.width) < want[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        return np.where(beyond, self.n, low)

    def at(self, index: np.ndarray) -> np.ndarray:
        """The elements at these indices."""
        low = unpack(self.low, index, self.width)
        ones = np.arange(len(self.zeros)) * 8 - self.zeros
        byte = np.searchsorted(ones, index, side="right") - 1
        rest, value = index - ones[byte], self.high[byte].astype(np.int64)
        place, found = np.zeros(len(index), np.int64), np.zeros(len(index), bool)
        for bit in range(8):
            one = ((value >> bit) & 1) == 1
            hit = one & (rest == 0) & ~found
            place[hit] = bit
            found |= hit
            rest = rest - (one & ~found)
        return ((byte * 8 + place - index).astype(U) << U(self.width)) | low

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1."""
        if self.n and len(keys) > self.n // MANY:
            every = _all(self.n, self.width, self.low, self.high)
            i = np.searchsorted(every, keys)
            return np.where((i < self.n) & (every[np.minimum(i, self.n - 1)] == keys), i, -1)
        i = self.successor(keys)
        inside = np.minimum(i, max(self.n - 1, 0))
        return np.where((i < self.n) & (self.at(inside) == keys), i, -1) if self.n else np.full(len(keys), -1)
