"""Words and word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker keeps.
CACHE = 150_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Words (bytes) to 64-bit hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


HASHES = Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def lower_words(text: bytes) -> list[bytes]:
    """Words as runs of anything but ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def shingles(words: list[bytes], k: int = 5) -> np.ndarray:
    """The distinct hashes of k-word shingles, sorted; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    n = max(len(w) - k + 1, 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(w))):
        h = mixed(h * ODD + w[i : i + n])
    return np.unique(h + np.uint64(len(w) if len(w) < k else k))
