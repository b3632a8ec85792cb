"""Vectorised hashing of the words and word windows of a batch of texts (numpy on Arrow buffers).

All arithmetic is modulo 2**64.  A word is hashed by a multilinear form over its bytes, a window by a polynomial over
its words' mixed hashes, read as a difference of prefix sums, so that a window of any length costs the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Letters that are hashed at once, and places in a word whose multipliers are looked up.
LETTERS, TABLE = 4 << 20, 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers of the two window polynomials.
_BASES = (U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93 | 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser with full avalanche (splitmix64's constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 0x1000193)) * U(0x9E3779B97F4A7C15))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and len(texts) + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """The words of a batch: ``start`` and ``end`` (byte offsets), ``hash``, and ``first``, each text's first word (one more than texts)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.raw, self.offsets = raw, offsets = bytes_of(texts)
        if lower:
            raw = _LOWER[raw]
        word = ~_SPACE[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        before[inner], after[inner - 1] = False, False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.hash = self._hash(raw[word])

    def _hash(self, letters: np.ndarray) -> np.ndarray:
        lens = self.end - self.start
        if not len(lens):
            return np.zeros(0, U)
        sums = np.zeros(len(lens), U)
        at = np.cumsum(lens) - lens
        table = seeded(min(int(lens.max()), TABLE), 1)
        lo = 0
        while lo < len(lens):  # blocks of whole words, and of parts of words that are longer than a block
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + LETTERS, "right")) - 1)
            for s in range(int(at[lo]), int(at[hi - 1] + lens[hi - 1]), LETTERS if hi == lo + 1 else 1 << 62):
                e = int(at[hi - 1] + lens[hi - 1]) if hi > lo + 1 else min(s + LETTERS, int(at[lo] + lens[lo]))
                inside = np.arange(s, e, dtype=np.int64) - (at[lo] if hi == lo + 1 else np.repeat(at[lo:hi], lens[lo:hi]))
                terms = table[inside] if lens[lo:hi].max() <= TABLE else mix((inside.astype(U) + U(1) + U(0x1000193)) * U(0x9E3779B97F4A7C15))
                terms *= letters[s:e].astype(U) + U(1)
                if hi == lo + 1:
                    sums[lo : lo + 1] += terms.sum(dtype=U)
                else:
                    sums[lo:hi] = np.add.reduceat(terms, at[lo:hi] - s)
            lo = hi
        return mix(sums ^ lens.astype(U) * U(0xA24BAED4963EE407))

    def windows(self, n: int, which: int = 0) -> np.ndarray:
        """Hash of the n words that start at each word (of those with n words left in the batch; texts are not looked at)."""
        if len(self.hash) < n:
            return np.zeros(0, U)
        if not hasattr(self, "_sums"):
            self._sums = {}
        if which not in self._sums:
            b = _BASES[which]
            inverse = U(pow(int(b), -1, 1 << 64))
            power = np.cumprod(np.full(len(self.hash), b))
            total = np.zeros(len(self.hash) + 1, U)
            np.cumsum(self.hash * power, out=total[1:])
            self._sums[which] = total, np.cumprod(np.full(len(self.hash), inverse))
        total, back = self._sums[which]
        return mix((total[n:] - total[:-n]) * back[: len(total) - n])

    def whole(self, n: int) -> np.ndarray:
        """For each window start of :meth:`windows`: does the window lie in one text?"""
        left = np.repeat(self.first[1:], self.count)[: max(0, len(self.hash) - n + 1)]
        return np.arange(len(left)) + n <= left


def sliding(x: np.ndarray, n: int, f=np.minimum) -> np.ndarray:
    """f over each n neighbours, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[:-step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x
