"""Byte kernels for repeated-passage detection: rank names by doubling, and window anchors.

A *rank name* of length h at byte p is a 64-bit name of the h bytes that start there. The name of
2h bytes is made from the pair (name of h bytes at p, name of h bytes at p + h), which is the rank
pair of prefix doubling; equal bytes have equal names wherever they stand.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_MIX_A, _MIX_B, _MIX_C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mixing of 64-bit values (wrap-around arithmetic)."""
    x = x ^ (x >> U(30))
    x *= _MIX_B
    x ^= x >> U(27)
    x *= _MIX_C
    x ^= x >> U(31)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of a rank pair."""
    x = left * _MIX_A
    x += right
    x ^= x >> U(29)
    x *= _MIX_B
    x ^= x >> U(32)
    return x


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0xD6E8FEB86659FD93
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of [^\\x20\\x09-\\x0D] start and end."""
    gap = np.concatenate([[True], _GAP[data], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def word_names(data: np.ndarray, first: np.ndarray, end: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """64-bit names of the words at the given places, from running sums of their bytes; a piece of the text at a time."""
    out, k = np.empty(len(first), np.uint64), 0
    while k < len(first):
        at = int(first[k])
        to = max(k + 1, int(np.searchsorted(end, at + piece, "right")))
        n = int(end[to - 1]) - at
        if len(_POWERS[0]) <= n:
            size = np.full(2 * n + 1, _BASE, np.uint64), np.full(2 * n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            for i, x in enumerate(size):
                x[0] = 1
                _POWERS[i] = np.cumprod(x, dtype=np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[at : at + n]] * _POWERS[0][:n], out=sums[1:])
        a, b = first[k:to] - at, end[k:to] - at
        out[k:to] = scramble((sums[b] - sums[a]) * _POWERS[1][a])
        k = to
    return out


_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * _MIX_A)


def doubled(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Rank names of the byte array for the given powers of two; those longer than it are empty."""
    return doubled_names(_BYTE[data], lengths)


def doubled_names(names: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """The same from names of single places."""
    h, out = 1, {}
    for want in sorted(lengths):
        while h < want and len(names):
            names = pair(names[:-h], names[h:]) if len(names) > h else names[:0]
            h *= 2
        out[want] = names
    return out


def covered(names: np.ndarray, h: int, start: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Ranks of the ranges start to end, h to longest places long, from names of h places."""
    out = scramble((end - start).astype(np.uint64))
    for k in range(-(-longest // h)):
        out = pair(out, names[np.minimum(start + k * h, end - h)])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    m, h = x, 1
    while 2 * h <= w:
        m = np.minimum(m[:-h], m[h:])
        h *= 2
    return m if h == w else np.minimum(m[: len(x) - w + 1], m[w - h :])


def anchors(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window): for each run of w values of x, the leftmost least.

    Windows are named by their first position; each belongs to one entry, in order. The choice
    depends only on the values in the window, so equal windows have their anchor at the same place.
    """
    if len(x) < w:
        e = np.zeros(0, np.int64)
        return e, e, e
    least = sliding_min(x, w)
    # p is least in some window if the largest of the minima of the windows that hold it is its value
    top = ~sliding_min(~np.concatenate([np.zeros(w - 1, U), least, np.zeros(w - 1, U)]), w)
    at = np.flatnonzero(top[: len(x)] == x)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, at[at + 1 < len(least)] + 1])
    starts = np.unique(starts)
    j = np.searchsorted(at, starts)
    want = least[starts]
    while (off := np.flatnonzero(x[at[j]] != want)).size:
        j[off] += 1
    own = at[j]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    first = starts[new]
    return own[new], first, np.concatenate([first[1:] - 1, [len(least) - 1]])
