"""Elias-Fano sequences in flat bytes, searched by whole arrays of queries.

A sorted sequence of n integers below u keeps l = log2(u / n) low bits of each in a packed array, and the rest as unary gaps in
a bit vector: element i sets bit (x >> l) + i, so zeros separate the values of the high part. A directory holds the zeros before
each word; a select halves the directory, then the word.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_EACH = _U(0x0101010101010101)
_HIGH = _U(0x8080808080808080)
#: The place of the r-th set bit of a byte, at byte * 8 + r.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], np.uint8)


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th set bit (from 0) of each word, which has more than r."""
    r = r.astype(np.uint64)
    n = word - ((word >> _U(1)) & _U(0x5555555555555555))
    n = (n & _U(0x3333333333333333)) + ((n >> _U(2)) & _U(0x3333333333333333))
    n = ((n + (n >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH  # set bits up to and with each byte
    byte = np.bitwise_count(((r * _EACH | _HIGH) - n) & _HIGH).astype(np.uint64) * _U(8)  # bytes that end before it
    r -= ((n << _U(8)) >> byte) & _U(0xFF)
    return (byte + _IN_BYTE[((word >> byte) & _U(0xFF)) * _U(8) + r]).astype(np.int64)


def _windows(raw: np.ndarray) -> np.ndarray:
    """raw (with 8 spare bytes) as the 64-bit words that begin at each byte."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))


def encode(x: np.ndarray, u: int) -> bytes:
    """x: sorted unsigned 64-bit integers below u."""
    n = len(x)
    low = max(0, (u // n).bit_length() - 1) if n else 0
    if low > 56:
        raise ValueError("the universe is too large for so few elements")
    high = (x >> _U(low)).astype(np.int64)
    bits = np.zeros(-(-((u >> low) + n + 2) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little").tobytes()
    zeros = 64 - np.bitwise_count(np.frombuffer(upper, "<u8")).astype(np.int64)
    zeros = (np.cumsum(zeros) - zeros).astype("<u4" if len(bits) < 1 << 32 else "<u8")
    lower = b""
    if low:
        packed = []
        for i in range(0, n, 1 << 16):  # 65,536 elements take whole bytes
            part = x[i : i + (1 << 16)] & _U((1 << low) - 1)
            packed.append(np.packbits((part[:, None] >> np.arange(low, dtype=np.uint64)) & _U(1), bitorder="little").tobytes())
        lower = b"".join(packed)
    lower += bytes(8)
    head = np.array([n, low, len(upper), len(lower), zeros.itemsize], "<u8").tobytes()
    body = head + upper + lower + zeros.tobytes()
    return body + bytes(-len(body) % 8)


class Sequence:
    def __init__(self, raw: memoryview):
        self.n, self.low, upper, lower, size = np.frombuffer(raw, "<u8", 5).astype(int).tolist()
        self.upper = np.frombuffer(raw, "<u8", upper // 8, 40)
        self.bits = _windows(np.frombuffer(raw, "u1", upper + 8, 40))
        self.lower = _windows(np.frombuffer(raw, "u1", lower, 40 + upper))
        # Before each word of the upper bits: zeros, and ones.
        self.zeros = np.frombuffer(raw, f"<u{size}", upper // 8, 40 + upper + lower)
        self.ones = None
        self.size = 40 + upper + lower + size * (upper // 8)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero."""
        at = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        return 64 * at + _select_in_word(~self.upper[at], k - self.zeros[at].astype(np.int64))

    def _one(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one."""
        if self.ones is None:
            self.ones = (np.arange(len(self.zeros)) * 64 - self.zeros).astype(self.zeros.dtype)
        at = np.searchsorted(self.ones, k.astype(self.ones.dtype), "right") - 1
        return 64 * at + _select_in_word(self.upper[at], k - self.ones[at].astype(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        return (self.lower[at >> 3] >> (at & 7).astype(np.uint64)) & _U((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at i."""
        high = (self._one(i) - i).astype(np.uint64)
        return (high << _U(self.low)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1 where it is no element: the successor within the high part's bucket, by halving it. A
        bucket may hold any number of elements, where the sequence is dense."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high, want = (x >> _U(self.low)).astype(np.int64), x & _U((1 << self.low) - 1)
        # Behind the zero that ends the high part before, there is a one for each element of this one.
        begin = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)
        first = begin - high
        rest = ~(self.bits[begin >> 3] >> (begin & 7).astype(np.uint64))
        run = np.bitwise_count((rest & (~rest + _U(1))) - _U(1)).astype(np.int64)
        far = np.flatnonzero(run >= 57)  # the window shows so many bits for sure
        run[far] = self._zero(high[far]) - high[far] - first[far]
        stop = first + run
        todo = np.flatnonzero(first < stop)
        a, b, w = first[todo], stop[todo], want[todo]
        while len(todo):
            mid = (a + b) >> 1
            got = self._low(mid)
            hit = got == w
            out[todo[hit]] = mid[hit]
            less = got < w
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            on = ~hit & (a < b)
            todo, a, b, w = todo[on], a[on], b[on], w[on]
        return out
