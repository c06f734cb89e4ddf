"""Words as the data description defines them, and stable 64-bit hashes of words and word runs."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash

#: A word is a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-case words of a text; none of a null."""
    return WORD.findall(text.lower()) if text else []


@lru_cache(maxsize=400_000)
def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def run_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive codes (uint64), in order; empty if there are fewer."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += codes[k : k + m]
    return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values, so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and n offsets: permutations of the 64-bit numbers for MinHash."""
    r = np.random.Generator(np.random.PCG64(seed))
    full = np.iinfo(np.uint64).max
    return r.integers(0, full, n, np.uint64) | np.uint64(1), r.integers(0, full, n, np.uint64)
