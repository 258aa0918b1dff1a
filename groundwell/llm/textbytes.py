"""Vectorised word and hash arithmetic over the raw UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C17)
_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)
#: Bytes of text worked on at a time; temporaries are a small multiple of it.
SLICE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, SLICE + 1)
        base = np.full(size, _BASE, dtype=np.uint64)
        base[0] = 1
        _pow = np.cumprod(base)
        inverse = np.full(size, np.uint64(pow(int(_BASE), -1, 2**64)), dtype=np.uint64)
        inverse[0] = 1
        _inv = np.cumprod(inverse)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; one long text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """cs with which hash(s, e) = (cs[e] - cs[s]) * inverse power of s."""
    power, _ = _powers(len(data) + 1)
    cs = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=cs[1:])
    return cs


def span_hash(cs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(cs))
    return mix((cs[end] - cs[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram_hashes(cs: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of all strings of one width, in the order of their places."""
    _, inverse = _powers(len(cs))
    h = cs[width:] - cs[:-width]
    h *= inverse[: len(h)]
    h += np.uint64(width)
    return mix(h)


LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text counts of the words of texts that lie back to back in ``data``.

    Words are runs of the bytes in ``member``; by default, of all but white space.
    """
    n = len(data)
    solid = ~_WS[data] if member is None else member[data]
    before = np.ones(n + 1, dtype=bool)
    before[1:] = ~solid
    before[offsets] = True
    starts = np.flatnonzero(solid & before[:n])
    after = np.ones(n + 1, dtype=bool)
    after[:n] = ~solid
    after[offsets] = True
    ends = np.flatnonzero(solid & after[1:]) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in small ASCII letters, and how many each text has."""
    data = lower_ascii(data)
    starts, ends, counts = words(data, offsets)
    return (span_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)), counts


def shingles(
    data: np.ndarray, offsets: np.ndarray, n: int, level: Callable[[np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingle ids of each text, ascending, row pointers, and the words' hashes.

    With ``level``, a number for each word hash, the last are the least levels of the shingles' words.
    A text of fewer words has its whole sequence as its one shingle; without words it has none.
    """
    wh, counts = word_hashes(data, offsets)
    rows = len(offsets) - 1
    pointers = np.zeros(rows + 1, dtype=np.int64)
    if not len(wh):
        return wh, pointers, wh
    levels = None if level is None else level(wh)
    first = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    doc = np.repeat(np.arange(rows), counts)
    acc = np.zeros(len(wh), dtype=np.uint64)
    left = first[doc + 1] - np.arange(len(wh))  # words from here to the end of the text
    least = levels
    for k in range(n):
        part = np.zeros(len(wh), dtype=np.uint64)
        inside = np.flatnonzero(left > k)
        part[inside] = wh[inside + k]
        if levels is not None and k:
            least = least.copy() if k == 1 else least
            least[inside] = np.minimum(least[inside], levels[inside + k])
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1))
    keep = (left >= n) | ((counts[doc] < n) & (left == counts[doc]))
    h, d = acc[keep], doc[keep]
    order = np.argsort(h)
    order = order[np.argsort(d[order].astype(np.uint16) if rows < 65536 else d[order], kind="stable")]
    h, d = h[order], d[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[fresh], d[fresh]
    pointers[1:] = np.cumsum(np.bincount(d, minlength=rows))
    return h, pointers, wh if levels is None else least[keep][order][fresh]


def byte_ranges(sizes: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, from the rows' sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])
    return slices(ends, limit)
