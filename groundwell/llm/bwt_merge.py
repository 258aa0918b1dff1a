"""Merging shard Burrows-Wheeler transforms by iterative interleave refinement.

Strings are read in blocks: the symbol at a position is the block that begins there, so that a
refinement step sharpens every interval by a whole block. Block symbols are 64-bit hashes; their
order is arbitrary but the same in all shards, which is all that intervals of equal strings need.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textbytes import mix, prefix_hash, span_hash


@dataclass
class Shard:
    """Suffixes of a shard in sorted order, and the transform: the symbol before each of them."""

    order: np.ndarray
    transform: np.ndarray


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """Places in order of their symbols, equal ones as they come.

    Symbols are sorted with their places in the low bits, which is quicker than sorting indices. Should
    two different symbols agree in the bits that are left, they are sorted in full.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int64)
    low = (np.uint64(1) << np.uint64(max(n - 1, 1).bit_length())) - np.uint64(1)
    key = symbols & ~low
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    key &= low
    order = key.view(np.int64)
    s = symbols[order]
    apart = s[1:] ^ s[:-1]
    apart -= np.uint64(1)  # equal ones go round to the greatest
    if len(apart) and apart.min() < low:
        return np.argsort(symbols, kind="stable")
    return order


def shard(data: np.ndarray, ends: np.ndarray, block: int, depth: int) -> Shard:
    """``data`` holds strings end to end. Suffixes are sorted by their first ``depth`` blocks.

    Only places with a whole block of their string left have a symbol and a suffix. What a suffix reads
    beyond the last of them begins its string again; such suffixes are too short to be asked for.
    """
    starts = np.concatenate([[0], ends[:-1]])
    size = np.maximum(ends - starts - block + 1, 0)
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(first, size)
    place = np.repeat(starts, size) + inside
    symbol = span_hash(prefix_hash(data), place, place + block)
    rest, count = inside % block, np.repeat(size, size)
    last = rest + (count - 1 - rest) // block * block
    before = np.arange(len(place)) - inside + np.where(inside >= block, inside - block, last)
    order = before
    for i in range(depth):
        order = before[order] if i else order
        order = order[stable_order(symbol[order])]
    return Shard(place[order], symbol[before[order]])


def interleave(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order without sorting suffixes again: (shard of each place, its interval).

    Each step reads the transforms along the interleave so far and deals the places out by symbol;
    after k steps it is right for the first k blocks, and neighbours lie in one interval if their
    common prefix has k blocks at least.
    """
    sizes = [len(s.order) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    symbols = np.concatenate([s.transform for s in shards])
    interval = np.zeros(len(z), dtype=np.int64)
    c = np.empty_like(symbols)
    for i in range(depth):
        if i:
            c[np.argsort(z, kind="stable")] = symbols
        else:
            c[:] = symbols  # shards lie one after the other
        step = stable_order(c)
        z, s, old = z[step], c[step], interval[step]
        together = np.zeros(len(z), dtype=bool)
        together[1:] = (s[1:] == s[:-1]) & (old[1:] == old[:-1])
        interval = np.cumsum(~together)
    return z, interval


def repeated(shards: list[Shard], offsets: np.ndarray, depth: int, physical: np.ndarray, valid: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Positions (over all shards, shifted by ``offsets``) whose first ``depth`` blocks occur elsewhere.

    ``physical`` names the real place of every position, so that one place seen twice is not a
    repeat; ``known`` marks positions whose string is known to occur again. Only ``valid`` positions count.
    """
    z, interval = interleave(shards, depth)
    place = np.empty(len(z), dtype=np.int64)
    place[np.argsort(z, kind="stable")] = np.concatenate([s.order + o for s, o in zip(shards, offsets, strict=True)])
    ok = valid[place]
    place, interval = place[ok], interval[ok]
    if not len(place):
        return place
    first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    real = physical[place]
    many = np.minimum.reduceat(real, first) != np.maximum.reduceat(real, first)
    many |= np.logical_or.reduceat(known[place], first)
    return place[np.repeat(many, np.diff(np.append(first, len(place))))]
