"""Words of a text as arrays of 64-bit identities, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

from .ranks import scramble

#: A-Z to a-z; digits, letters and bytes of other scripts as they are; all else parts words.
_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEPT = 250_000


class Identities(dict):
    """word -> 64-bit identity; a table of bounded size of those met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_ids = Identities()


def identities(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_ids.__getitem__, words), np.uint64, len(words))


def spaced_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then the runs of [^\\x20\\x09-\\x0D]."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then the runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]."""
    return text.translate(_ALNUM).split()


def runs(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word's place."""
    if len(ids) < n:
        return ids[:0]
    h = ids[: len(ids) - n + 1].copy()
    for i in range(1, n):
        h *= _STEP
        h += ids[i : len(ids) - n + 1 + i]
    return scramble(h)
