"""Word shingles as 64-bit hashes, many documents at a time.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text with A-Z
lower-cased. A shingle is a window of ``width`` words; a text with fewer words (but one at
least) has its whole word sequence as the only shingle; a null, empty or blank text has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64; a bijection, so distinct inputs stay distinct."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (hashes, offsets); those of text i are sorted and
    stand at ``hashes[offsets[i]:offsets[i + 1]]``."""
    look = xxhash.xxh64_intdigest
    sets: list[np.ndarray] = []
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(width)]
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if not words:
            sets.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(look, words), np.uint64, len(words))
        k = min(width, len(words))
        s = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            s += h[j : len(h) - k + 1 + j] * factors[j]
        s = mix(s + np.uint64(k))
        s.sort()
        if len(s) > 1:
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        sets.append(s)
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), offsets
