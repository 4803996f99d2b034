"""Simple-8b: word-aligned packing of non-negative integers, vectorised with numpy.

A 64-bit word's upper four bits are its selector, the lower 60 its payload. Selector s >= 1 holds COUNTS[s] values
of BITS[s] bits, the first value lowest. Selector 0 is an escape: the value is the whole next word, for values of
more than 60 bits. A block is a header, then its words; the header holds the number of values and words, so that
blocks can be found and decoded one by one.
"""

from __future__ import annotations

import numpy as np

#: A width for each count of values that uses the 60 bits differently, from the widest run of values to one value.
BITS = np.array([0] + [b for b in range(1, 61) if b == 60 or 60 // b > 60 // (b + 1)], dtype=np.uint64)
COUNTS = np.array([1] + [60 // int(b) for b in BITS[1:]], dtype=np.int64)


def _widths(values: np.ndarray) -> np.ndarray:
    """The bits that each value needs, 1 at least."""
    out = np.ones(len(values), dtype=np.uint8)
    rest = values >> np.uint64(1)
    while rest.any():
        out += rest > 0
        rest >>= np.uint64(1)
    return out


def _best(values: np.ndarray) -> np.ndarray:
    """For each position the selector that packs the most values from there on."""
    n, width = len(values), _widths(values)
    best = np.zeros(n, dtype=np.uint8)
    runs = {1: width}  # maxima of so many widths from a position on
    span = 1
    while span * 2 <= min(n, 60):
        a = runs[span]
        runs[span * 2] = np.maximum(a[:-span], a[span:])
        span *= 2
    for s in range(len(BITS) - 1, 0, -1):
        count, bits = int(COUNTS[s]), int(BITS[s])
        if count > n:
            continue
        half = 1 << (count.bit_length() - 1)
        a = runs[half]
        fits = np.maximum(a[: n - count + 1], a[count - half : n - half + 1]) <= bits
        best[: n - count + 1][fits] = s
    return best


def encode(values: np.ndarray) -> np.ndarray:
    """uint64 values -> uint64 words. Values up to 2**64 - 1; those over 60 bits take two words."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    best = _best(values)
    step = COUNTS[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, dtype=np.int64)
    selectors = best[starts]
    escapes = selectors == 0
    at = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(escapes)[:-1]))
    words = np.zeros(len(starts) + int(escapes.sum()), dtype=np.uint64)
    for s in np.unique(selectors):
        mine = selectors == s
        if s == 0:
            words[at[mine] + 1] = values[starts[mine]]
            continue
        packed = np.full(int(mine.sum()), np.uint64(s) << np.uint64(60), dtype=np.uint64)
        first = starts[mine]
        for k in range(int(COUNTS[s])):
            packed |= values[first + k] << (BITS[s] * np.uint64(k))
        words[at[mine]] = packed
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of encode()'s words."""
    words = np.asarray(words, dtype=np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if not selectors.all():  # a word after an escape is no word of its own; only blocks with escapes come here
        raw, k = np.zeros(len(words), dtype=bool), 0
        zeros = set(np.flatnonzero(selectors == 0).tolist())
        for k in sorted(zeros):
            if not raw[k]:
                raw[k + 1] = True
        values_at = np.flatnonzero(~raw)
    else:
        values_at = np.arange(len(words))
    chosen = selectors[values_at]
    counts = COUNTS[chosen]
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        first = starts[mine]
        if s == 0:
            out[first] = words[values_at[mine] + 1]
            continue
        payload = words[values_at[mine]]
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[first + k] = (payload >> (BITS[s] * np.uint64(k))) & mask
    if len(out) != n:
        raise ValueError(f"a block holds {len(out)} values, its header says {n}")
    return out
