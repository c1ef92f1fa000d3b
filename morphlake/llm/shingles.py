"""Word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

from morphlake.llm.common import BASE, MIX_1, MIX_2, mixed, powers

#: ASCII white space; what stands at a place is 1.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_2)[LOWER]

_POWERS: list = [powers(0), powers(0)]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start in bytes) of each word, in order; a word is a run of bytes that aren't ASCII white space, A-Z taken as a-z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(_POWERS[0]) <= n:
        _POWERS[:] = powers(n), powers(n, np.uint64(pow(int(BASE), -1, 2**64)))
    inside = ~WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = offsets[1:-1][(offsets[1:-1] < n)]
    first[inner] = inside[inner]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = inner[inner > 0] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * _POWERS[0][:n], out=sums[1:])
    value = mixed((sums[end] - sums[start]) * _POWERS[1][start] + (end - start).astype(np.uint64))
    return value, np.searchsorted(offsets, start, side="right") - 1, start


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of `size` words in order; a text with fewer words, but with some, is one shingle."""
    value, text, _ = words(data, offsets)
    count = np.bincount(text, minlength=len(offsets) - 1) if len(text) else np.zeros(len(offsets) - 1, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    h = np.full(max(0, len(value) - size + 1), np.uint64(size))
    for k in range(size if len(h) else 0):
        h *= BASE
        h += value[k : len(h) + k]
    h = mixed(h)
    keep = text[size - 1 :] == text[: len(h)] if len(h) else np.zeros(0, bool)
    out, where = h[keep], text[: len(h)][keep]
    if len(short):
        begin = np.cumsum(count) - count
        own = []
        for d in short.tolist():
            x = np.uint64(7)
            for v in value[begin[d] : begin[d] + count[d]]:
                x = mixed(np.array([int(x) * int(BASE) + int(v) & 2**64 - 1], np.uint64))[0]
            own.append(x)
        out, where = np.concatenate([out, np.array(own, np.uint64)]), np.concatenate([where, short])
        order = np.argsort(where, kind="stable")
        out, where = out[order], where[order]
    return out, where


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    h, where = shingles(data, offsets, size)
    cuts = np.searchsorted(where, np.arange(len(offsets)))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
