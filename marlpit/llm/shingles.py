"""Word shingles of whole texts as 64-bit hashes, for many texts at once.

Words are lower-cased runs of letters and digits. A text of at least ``width`` words has a shingle at each run of that
many; a shorter one has a single shingle of all its words; one without words, or null, has none.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np

from .common import words

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


class Shingler:
    def __init__(self, width: int = 5, memo: int = 300_000):
        self.width, self.memo, self.known = width, memo, _Memo()
        self.weights = [int(x) for x in mix(np.arange(1, width + 1, dtype=np.uint64) * _STEP) | np.uint64(1)]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of all texts in order, repeats included, and where each text's begin (one more at the end)."""
        split = [words(t) for t in texts]
        lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        total = int(lengths.sum())
        if len(self.known) > self.memo:
            self.known.clear()
        hashes = np.zeros(total + self.width, dtype=np.uint64)
        hashes[:total] = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=total)
        runs = np.zeros(total, dtype=np.uint64)
        for k, weight in enumerate(self.weights):
            runs += hashes[k : k + total] * np.uint64(weight)
        counts = np.where(lengths >= self.width, lengths - self.width + 1, np.minimum(lengths, 1))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        begins = np.cumsum(lengths) - lengths
        at = np.repeat(begins - offsets[:-1], counts) + np.arange(offsets[-1])
        out = runs[at]
        for i in np.flatnonzero((lengths > 0) & (lengths < self.width)):
            start, n = begins[i], int(lengths[i])
            value = sum(int(hashes[start + k]) * self.weights[k] for k in range(n)) + n * int(_STEP)
            out[offsets[i]] = value & 0xFFFFFFFFFFFFFFFF
        return mix(out), offsets
