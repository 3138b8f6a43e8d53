"""SuperMinHash signatures of sets of 64-bit values.

Each value has its own random permutation of the slots; the j-th slot of the permutation is offered
j plus a random fraction, and a slot keeps the least it is offered. Two sets agree in a slot with
the probability of their Jaccard likeness, with less variance than independent hashes give, as the
slots of one value are drawn without repetition. All values are taken through their permutations
together, one step at a time; once every slot holds less than j, step j can change nothing, and the
signature is done (early stopping) - after one step for most sets of a thousand values and more.
"""

from __future__ import annotations

import numpy as np

from .ranks import scramble

U = np.uint64
_LOW = U(0xFFFFFFFF)


def signature(values: np.ndarray, m: int) -> np.ndarray:
    """m slots, each step << 32 | fraction; all ones for the empty set. values are distinct."""
    slots = np.full(m, ~U(0), np.uint64)
    n = len(values)
    if not n:
        return slots
    state = scramble(values ^ U(0xA0761D6478BD642F))
    place: np.ndarray | None = None  # each value's permutation so far, once a second step is needed
    for j in range(m):
        state = scramble(state + U(0x9E3779B97F4A7C15))
        offered = (U(j) << U(32)) | (state >> U(32))
        k = j + ((state & _LOW) * U(m - j) >> U(32)).astype(np.int64)
        if place is None and j == 0:
            at = k
        else:
            if place is None:
                place = np.tile(np.arange(m, dtype=np.int16), (n, 1))
                row = np.arange(n)
                place[row, first], place[row, 0] = 0, first
            at = place[row, k].astype(np.int64)
            place[row, k] = place[row, j]
            place[row, j] = at
        np.minimum.at(slots, at, offered)
        if slots.max() < U(j + 1) << U(32):
            break
        if j == 0:
            first = k
    return slots


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each run of rows slots."""
    s = sig.reshape(-1, rows)
    h = scramble(s[:, 0] + np.arange(len(s), dtype=np.uint64) * U(0xD6E8FEB86659FD93))
    for i in range(1, rows):
        h = scramble(h * U(0x9E3779B97F4A7C15) + s[:, i])
    return h


def brief(sig: np.ndarray) -> np.ndarray:
    """16 bits of each slot, to compare many signatures in little room."""
    return (scramble(sig) >> U(48)).astype(np.uint16)
