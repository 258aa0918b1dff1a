"""How often the corpus has a word or an n-gram: sketches of counters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are told by from 2 ** 18 to 2 ** 23 counters, as the corpus needs. They only order, so errors cost
#: time alone. N-grams have 2 ** 21: they tell the long lists, after a counter's mean is taken off as noise.
LEAST_BITS, MOST_BITS = 18, 23
GRAM_BITS = 21
#: Standard deviations above the mean from which a counter's n-grams are taken for those of long lists.
SURE = 1.5
#: Bytes of text to a counter of words.
COUNTER_BYTES = 32
CHUNKS = 64


def sketch_bits(docs: DataFrame, text_col: str = "_text") -> int:
    """Bits of the number of counters of words for a table of texts."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(LEAST_BITS, min(MOST_BITS, (size // COUNTER_BYTES).bit_length()))


def counter(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counters by byte planes: the high planes are nearly all zeros."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def chunks(words: np.ndarray, grams: np.ndarray | None = None) -> tuple[list[int], list[bytes]]:
    """Numbers and counters of the parts in which one task's counters are added up: words, then n-grams."""
    parts = [*np.split(words, CHUNKS), *([] if grams is None else np.split(grams, CHUNKS))]
    return list(range(len(parts))), [_packed(c) for c in parts]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up counters chunk by chunk; holds one array for each chunk, however many tasks wrote them."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = _unpacked(c)
            old = total.get(k)
            total[k] = new.copy() if old is None else old + np.minimum(new, np.uint32(2**32 - 1) - old)
    keys = sorted(total)
    blobs = [_packed(total[k]) for k in keys]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "counts"])


def _levelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, counts): words as the logarithms of their counters, a byte each; n-grams as they are."""
    for batch in _added(batches):
        ks = batch.column(0).to_pylist()
        blobs = [c if k >= CHUNKS else zlib.compress(levels(_unpacked(c)).tobytes(), 1) for k, c in zip(ks, batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["chunk", "counts"])


#: Levels of a count to a doubling.
STEPS = 8


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of a byte, exact up to eight."""
    return np.minimum(np.round(STEPS * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


@dataclass
class Sketch:
    """Levels of words and counters of n-grams."""

    level: np.ndarray
    grams: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.level).bit_length() - 1

    @cached_property
    def mean(self) -> float:
        """What a counter of n-grams holds on average; summed once, for there are millions of counters to a text's few n-grams."""
        return self.grams.mean(dtype=np.float64)

    def common(self, words: np.ndarray) -> np.ndarray:
        """Levels of words, to order them by: 0 for words that the corpus has once."""
        return self.level[counter(words, self.bits)]

    def word_lists(self, level: np.ndarray) -> np.ndarray:
        """Lines that hold a word of a level, at most."""
        return 2.0 ** (level / STEPS)

    def gram_lists(self, grams: np.ndarray) -> np.ndarray:
        """Texts that hold an n-gram, less what its counter holds of others on average."""
        return np.maximum(self.grams[counter(grams, GRAM_BITS)] - self.mean, 1)

    def order(self, grams: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Numbers to order n-grams by: those of passages that many texts hold come last, however rare their words."""
        more = self.gram_lists(grams)
        doublings = np.where(more >= 2 + SURE * np.sqrt(self.mean), np.floor(np.log2(more)), 0)
        return doublings.astype(np.uint16) * np.uint16(256) + level


def summed(parts: DataFrame, bits: int) -> Sketch:
    """The sketch of all tasks' (chunk, counts)."""
    spread = parts.select("chunk", "counts").repartition(CHUNKS).mapInArrow(_added, "chunk int, counts binary")
    rows = spread.repartition(CHUNKS, "chunk").mapInArrow(_levelled, "chunk int, counts binary").collect()
    level = np.zeros((CHUNKS, (1 << bits) // CHUNKS), dtype=np.uint8)
    grams = np.zeros((CHUNKS, (1 << GRAM_BITS) // CHUNKS), dtype=np.uint32)
    for r in rows:  # 17 MB at most
        if r["chunk"] < CHUNKS:
            level[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint8)
        else:
            grams[r["chunk"] - CHUNKS] = _unpacked(r["counts"])
    return Sketch(level.reshape(-1), grams.reshape(-1))
