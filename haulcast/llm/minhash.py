"""Minima of many universal hashes over sets of 64-bit numbers, and bands of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from haulcast.llm.words import chain, mix

CHUNK = 1 << 9


@dataclass(frozen=True)
class MinHash:
    """``bands * rows`` hashes ``a * x + b`` modulo 2**32 with odd ``a``.

    Two sets of similarity s share a band with probability 1 - (1 - s**rows)**bands.
    """

    bands: int
    rows: int
    seed: int = 1

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @cached_property
    def _family(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        a = draw.integers(0, 1 << 31, self.size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        return a[:, None], draw.integers(0, 1 << 32, self.size, dtype=np.uint32)[:, None]

    def minima(self, elements: np.ndarray) -> np.ndarray:
        """One minimum per hash; ``elements`` is not empty. Long sets are taken in pieces."""
        a, b = self._family
        x = (elements >> np.uint64(32)).astype(np.uint32)
        low = (a * x[None, :CHUNK] + b).min(axis=1)
        for at in range(CHUNK, len(x), CHUNK):
            np.minimum(low, (a * x[None, at : at + CHUNK] + b).min(axis=1), out=low)
        return low

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One key per band for each row of ``signatures``; keys of different bands never mean the same."""
        rows = signatures.astype(np.uint64).reshape(len(signatures), self.bands, self.rows)
        out = np.empty((len(signatures), self.bands), np.uint64)
        for band in range(self.bands):
            out[:, band] = chain(list(rows[:, band, :].T), band + 1)
        return out

    def least_agreement(self, similarity: float, sigmas: float = 7.0) -> int:
        """Equal minima below which sets are surely less similar: so many deviations under the mean."""
        mean = self.size * similarity
        return max(0, int(mean - sigmas * np.sqrt(mean * (1 - similarity))))


def set_digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set: sums of two mixes of its elements."""
    first = mix(elements)
    return int(first.sum(dtype=np.uint64)), int(mix(first ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))
