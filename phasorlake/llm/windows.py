"""Hashes of word windows over many documents at once, in numpy.

The hash of k words is a polynomial over the words' 64-bit hashes modulo 2^64, got
from prefix sums: sum(h[i] * b^i) from a to a + k, times b^-a. Any k costs the same.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

#: Bytes of text that a kernel holds at once, beyond a single document.
CHUNK = 2_000_000
MEMO = 300_000
ONE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_TOP = np.uint64(2**64 - 1)


class WordHashes(dict):
    """Word to 64-bit hash; emptied when full, so that its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Windows:
    """The words of some documents in a row, and hashes of their windows."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, texts: list[list[bytes]], memo: WordHashes):
        self.ends = np.cumsum([len(t) for t in texts])
        self.n = int(self.ends[-1]) if len(texts) else 0
        self.h = np.fromiter(map(memo.__getitem__, chain.from_iterable(texts)), np.uint64, self.n)
        self.doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])

    def hashes(self, k: int, base: int = ONE) -> np.ndarray:
        """Hash of the k words from each place on; the last k - 1 places have none."""
        up, down = self.powers.get(base, (np.empty(0, np.uint64),) * 2)
        if len(up) < self.n:
            up, down = (np.full(max(CHUNK // 4, self.n), x, np.uint64) for x in (base, pow(base, -1, 2**64)))
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if len(up) == CHUNK // 4:
                self.powers[base] = (up, down)
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * up[: self.n])])
        return _mix((s[k:] - s[:-k]) * down[: self.n - k + 1])

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each place on are of one document."""
        return self.doc[: self.n - k + 1] == self.doc[k - 1 :]

    def seeds(self, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seed hashes by place, the least one of each window by its start, whether the window is whole."""
        hs = np.where(self.whole(seed), self.hashes(seed), _TOP)
        span = width - seed + 1
        least, have = hs, 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        return hs, least, self.whole(width)

    def chosen(self, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and hashes of the places that are the least of a whole window."""
        hs, least, whole = self.seeds(width, seed)
        span = width - seed + 1
        edge = np.zeros(span - 1, np.uint64)
        most, have = np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), 1
        while have < span:
            step = min(have, span - have)
            most = np.maximum(most[:-step], most[step:])
            have += step
        at = np.flatnonzero((most == hs) & (hs != _TOP))
        return self.doc[at], hs[at]
