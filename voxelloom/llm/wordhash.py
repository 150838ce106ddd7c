"""Word and shingle hashes of many texts at once, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Texts are taken together up to so many bytes, at least one at a time.
TOGETHER = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over each other, one to one."""
    h = (h ^ (h >> _S)) * _M
    h ^= h >> _S
    h *= _M
    h ^= h >> _S
    return h


def grouped(texts: list[bytes], limit: int = TOGETHER) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts with their first index."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first byte and byte length of every word, in order.

    Words are runs of anything but space and the ASCII line and tab controls.
    A hash is a polynomial over the word's bytes, spread by ``mixed``.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    sizes = ends - starts
    if lower:
        data = _LOWER[data]
    powers = np.cumprod(np.full(int(sizes.max()), _K))
    data, space, rel = data[starts[0] :], space[starts[0] :], starts - starts[0]
    inside = np.arange(len(data)) - np.repeat(rel, np.diff(np.r_[rel, len(data)]))
    inside = np.minimum(inside, len(powers) - 1)
    value = (data.astype(np.uint64) + np.uint64(1)) * powers[inside]
    value[space] = 0
    hashed = mixed(np.add.reduceat(value, rel) + sizes.astype(np.uint64))
    of = np.searchsorted(bounds, starts, side="right")
    return hashed, of, starts - np.r_[0, bounds][of], sizes


def runs(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, over text borders too."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashed[:n].copy()
    for k in range(1, size):
        out = mixed(out * _K + hashed[k : k + n])
    return out


def shingle_sets(texts: list[bytes], size: int, lower: bool = False) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a shorter text is one shingle."""
    for _, held in grouped(texts):
        hashed, of, _, _ = word_hashes(held, lower)
        full = runs(hashed, size)
        edges = np.searchsorted(of, np.arange(len(held) + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= size:
                yield np.unique(full[a : b - size + 1])
            elif b > a:
                yield runs(hashed[a:b] ^ np.uint64(b - a), b - a)
            else:
                yield full[:0]
