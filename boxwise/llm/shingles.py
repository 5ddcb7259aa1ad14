"""Word shingles and MinHash signatures, a batch of texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    """Hashes of words, kept for the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct ``size``-word shingles of a text.

    Words are runs of letters, digits and underscores in lower case. A text
    of fewer words is one shingle of all it has; one without words has none.
    """
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = mixed * _MULTIPLIER + hashes[k : n + k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _FINAL
    mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed)


def minhash_family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    return (draw() << np.uint64(1)) | np.uint64(1), draw()


def signatures(sets: list[np.ndarray], family: tuple[np.ndarray, np.ndarray], chunk: int = 1 << 16) -> np.ndarray:
    """MinHash signatures (uint32) of sets that are not empty, one row each."""
    out = np.empty((len(sets), len(family[0])), np.uint32)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= chunk):
            total += len(sets[end])
            end += 1
        joined = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for k, (a, b) in enumerate(zip(*family, strict=True)):
            out[at:end, k] = np.minimum.reduceat(((joined * a + b) >> np.uint64(32)).astype(np.uint32), starts)
        at = end
    return out


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as rows of uint8."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def runs(*columns: np.ndarray) -> Iterable[tuple[int, int]]:
    """The bounds of runs of rows that agree in all columns."""
    n = len(columns[0])
    if n:
        change = np.zeros(n - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1] if c.ndim == 1 else (c[1:] != c[:-1]).any(axis=1)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        yield from zip(cuts[:-1], cuts[1:], strict=True)
