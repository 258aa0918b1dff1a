"""Token counts by rank-synchronous merging of batched pre-tokens held as numpy arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from .runtime import private_names
from .textbytes import byte_ranges

_NONE = np.int32(2**31 - 1)
#: Longer pre-tokens are merged one by one through a priority queue: same result, n log n steps.
LONG = 256
#: Symbols merged side by side.
BATCH = 1 << 16
#: Pre-tokens remembered by a task before it starts afresh.
REMEMBERED = 400_000
_RUNS = re.compile(r" *[^ ]+| +")


class Merger:
    """The merges of a BPE piece model, as arrays."""

    def __init__(self, model: P.PieceModel) -> None:
        if not model.dummy_prefix:
            raise ValueError("models without a dummy prefix are not supported")
        normal = {t: i for i, (t, k) in enumerate(zip(model.texts, model.kinds, strict=True)) if k == P.NORMAL}
        self.size = len(model.texts)
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        code = np.arange(0x110000)
        # Unknown characters stand for as many byte tokens as UTF-8 needs.
        self.char_ids[:] = self.size + 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        for t, i in normal.items():
            if len(t) == 1:
                self.char_ids[ord(t)] = i
        self.weights = np.ones(self.size + 5, dtype=np.int64)
        self.weights[self.size :] = np.arange(5)
        order = {s: r for r, s in enumerate(sorted({model.scores[i] for i in normal.values()}, reverse=True))}
        left, right, rank, made = [], [], [], []
        for t, i in normal.items():
            for k in range(1, len(t)):
                a, b = normal.get(t[:k]), normal.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(order[model.scores[i]])
                    made.append(i)
        keys = np.array(left, dtype=np.int64) * (self.size + 5) + np.array(right, dtype=np.int64)
        self._build(keys, np.array(rank, dtype=np.int32), np.array(made, dtype=np.int32))

    def _build(self, keys: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        n = 1 << self.bits
        self.keys = np.full(n, -1, dtype=np.int64)
        self.rank = np.full(n, _NONE, dtype=np.int32)
        self.made = np.full(n, -1, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            slot, who = at[put], todo[put]
            self.keys[slot], self.rank[slot], self.made[slot] = keys[who], rank[who], made[who]
            rest = np.ones(len(todo), dtype=bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & (n - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting symbol of adjacent symbols."""
        keys = a.astype(np.int64) * (self.size + 5) + b
        at = self._slot(keys)
        hit = self.keys[at] == keys
        for _ in range(self.probes - 1):
            open_ = ~hit & (self.keys[at] != -1)
            if not open_.any():
                break
            at = np.where(open_, (at + 1) & ((1 << self.bits) - 1), at)
            hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], _NONE), np.where(hit, self.made[at], -1)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (written with plain spaces for the space symbol)."""
        out = np.zeros(len(tokens), dtype=np.int64)
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._queue(self.symbols(tokens[i]))
        order = np.argsort(lengths, kind="stable")
        order = order[(lengths[order] > 0) & (lengths[order] <= LONG)]
        ends = np.cumsum(lengths[order])
        at = 0
        while at < len(order):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH)))
            part = order[at:upto]
            out[part] = self._merge(self.symbols("".join([tokens[i] for i in part])), lengths[part])
            at = upto
        return out

    def symbols(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.replace(" ", P.SPACE).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return self.char_ids[code]

    def _merge(self, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sequences end to end in one array, ``size`` symbols each: in every step each of them merges its
        lowest-ranked, leftmost pair. Those without one are counted and leave."""
        out = np.zeros(len(size), dtype=np.int64)
        symbol, alive = symbol.copy(), np.arange(len(size))
        rank = np.full(len(symbol), _NONE, dtype=np.int32)  # of each symbol with the next of its sequence
        made = np.full(len(symbol), -1, dtype=np.int32)
        inner = np.ones(len(symbol), dtype=bool)
        inner[np.cumsum(size) - 1] = False
        k = np.flatnonzero(inner)
        rank[k], made[k] = self.pairs(symbol[k], symbol[k + 1])
        while len(alive):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(len(rank)), starts)
            at, go = best & 0xFFFFFFFF, best >> 32 != _NONE
            if not go.all():
                done = ~go
                out[alive[done]] = np.add.reduceat(self.weights[symbol], starts)[done]
                if not go.any():
                    break
                stay = np.repeat(go, size)
                shift = np.cumsum(~stay)
                at = (at - shift[at])[go]
                symbol, rank, made, size, alive = symbol[stay], rank[stay], made[stay], size[go], alive[go]
                starts = np.cumsum(size) - size
            symbol[at] = made[at]
            stay = np.ones(len(symbol), dtype=bool)
            stay[at + 1] = False
            # The merged pair's second symbol goes, and one place less in all sequences after it.
            at, first = at - np.arange(len(at)), starts - np.arange(len(at))
            symbol, rank, made, size = symbol[stay], rank[stay], made[stay], size - 1
            last = first + size - 1
            rank[at[at == last]] = _NONE
            for k in (at[at < last], at[at > first] - 1):
                rank[k], made[k] = self.pairs(symbol[k], symbol[k + 1])
        return out

    def _queue(self, symbols: np.ndarray) -> int:
        ids = symbols.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.pairs(symbols[:-1], symbols[1:])
        queue = [(int(r), i, int(m), ids[i], ids[i + 1]) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r != _NONE]
        heapq.heapify(queue)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        alive = [True] * n
        while queue:
            _, i, m, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = m, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if x < 0 or y >= n:
                    continue
                pair = ids[x], ids[y]
                if pair not in known:
                    r, m2 = self.pairs(np.array([pair[0]]), np.array([pair[1]]))
                    known[pair] = int(r[0]), int(m2[0])
                if known[pair][0] != _NONE:
                    heapq.heappush(queue, (known[pair][0], x, known[pair][1], *pair))
        return int(sum(self.weights[ids[i]] for i in range(n) if alive[i]))


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(P.load(path))


def pre_tokens(text: str) -> list[str]:
    """Words with the spaces before them, less the first space; no piece reaches across the cut."""
    if P.SPACE in text:
        text = text.replace(P.SPACE, " ")
    cut = text.split(" ")
    if "" not in cut:
        return cut
    return [t[1:] for t in _RUNS.findall(" " + text)] if text else []


def count_texts(texts: list[str], path: str, known: dict[str, int]) -> list[int]:
    m = merger(path)
    cut = [pre_tokens(t) for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    missing = list(set().union(*cut) - known.keys())
    known.update(zip(missing, m.count([" " + t for t in missing]).tolist(), strict=True))
    return [sum(map(known.__getitem__, c)) for c in cut]


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row, without begin, end or added tokens.

    Null and empty texts have no tokens. Every row is counted by itself: repeated rows, ties and
    null ids pass through; other columns are ignored; an empty table gives no rows. Memory is
    bounded by the longest text and a fixed number of remembered words.
    """
    private_names(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1)
            counts: list[int] = []
            for start, end in byte_ranges(batch.column(2)):
                counts += count_texts([t or "" for t in texts.slice(start, end - start).to_pylist()], model_path, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"]
            )

    source = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    out = source.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
