"""Words, word shingles and their hashes, the same in every operator that uses them."""

from __future__ import annotations

import numpy as np
import xxhash

# ASCII letters are lower-cased; ASCII signs and controls part words; all else is kept.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
MAX_CACHED = 200_000  # word hashes kept per worker
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII digits and letters (lower-cased) and non-ASCII characters."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.  A text of fewer than
    ``size`` words, but not none, is one shingle; one without words has none."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > MAX_CACHED:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, own), np.uint64, len(own))
    k = min(size, len(h))
    rolled = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        rolled = rolled * _P + h[i:len(h) - k + 1 + i]
    return np.unique(mix(rolled + np.uint64(k)))
