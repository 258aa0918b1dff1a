"""SentencePiece encoding by streaming Viterbi, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from .runtime import private_names
from .textbytes import byte_ranges

REMEMBERED = 300_000
#: Without a boundary that no piece crosses, survivors are traced for a common one this often.
TRACE_EVERY = 64
#: Texts read side by side; fewer than FEW are streamed one after the other.
ROWS, FEW = 4096, 16
#: Symbols after the last common boundary that are kept side by side: bits of a bitmap.
WINDOW = 64
#: Scores at or below this are sentinels in model files; they become one less than the lowest other score.
SENTINEL = -1e8
UNKNOWN_PENALTY = 10.0


class Viterbi:
    """Best segmentation under the file's piece scores, read as a unigram model."""

    def __init__(self, model: P.PieceModel) -> None:
        normal = [(t, s, i) for i, (t, s, k) in enumerate(zip(model.texts, model.scores, model.kinds, strict=True)) if k == P.NORMAL]
        low = min(s for _, s, _ in normal if s > SENTINEL)
        self.unknown = (low - 1 if any(s <= SENTINEL for _, s, _ in normal) else low) - UNKNOWN_PENALTY
        #: Every beginning of a piece, so that a search stops as soon as no piece can follow.
        self.found: dict[str, tuple[float, int] | None] = {}
        for t, _, _ in normal:
            for k in range(1, len(t)):
                self.found.setdefault(t[:k], None)
        for t, s, i in normal:
            self.found[t] = (s if s > SENTINEL else low - 1, i)
        self.longest = max(len(t) for t, _, _ in normal)
        self.byte_ids = model.byte_ids
        self._tables(model, normal)
        self.texts = [t if k == P.NORMAL else "" for t, k in zip(model.texts, model.kinds, strict=True)]
        self.raw = [t.encode() for t in self.texts]
        for b, i in enumerate(model.byte_ids):
            self.raw[i] = bytes((b,))
        self.dummy_prefix = model.dummy_prefix
        self.streamed = 0  # texts that went through windows so far

    def _tables(self, model: P.PieceModel, normal: list[tuple[str, float, int]]) -> None:
        """The beginnings of pieces as a trie in an open-addressed table: (node, symbol) -> node."""
        nodes = {"": 0}
        for beginning in self.found:
            nodes[beginning] = len(nodes)
        chars = {c: n for n, c in enumerate(sorted({c for t, _, _ in normal for c in t}))}
        self.width = len(chars) + 1
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        for c, n in chars.items():
            self.symbol[ord(c)] = n
        keys = np.array([nodes[b[:-1]] * self.width + chars[b[-1]] for b in self.found], dtype=np.int64)
        self.bits = int(len(keys) * 4).bit_length()
        size = 1 << self.bits
        self.keys, self.nodes = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32)
        todo, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        targets = np.array([nodes[b] for b in self.found], dtype=np.int32)
        while len(todo):
            self.probes += 1
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.nodes[at[put]] = keys[todo[put]], targets[todo[put]]
            rest = np.ones(len(todo), dtype=bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & (size - 1)
        self.node_score = np.full(len(nodes), -np.inf)
        self.node_piece = np.full(len(nodes), -1, dtype=np.int32)
        for b, hit in self.found.items():
            if hit is not None:
                self.node_score[nodes[b]], self.node_piece[nodes[b]] = hit

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The node after one more symbol; 0 where no piece goes on."""
        keys = node.astype(np.int64) * self.width + symbol
        keys[symbol < 0] = -2
        at = self._slot(keys)
        there = self.keys[at]
        hit = there == keys
        for _ in range(self.probes - 1):
            open_ = ~hit & (there != -1)
            if not open_.any():
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys
        return np.where(hit, self.nodes[at], 0)

    def words(self, cells: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Many texts at once, each streamed through a window of its own.

        Returns the order in which the texts were done, the number of ids of each, and all ids.
        """
        lengths = np.fromiter(map(len, cells), dtype=np.int64, count=len(cells))
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        at, sizes, flats = 0, [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        while at < len(order):
            part = order[at : at + ROWS]
            # A window each costs the same however many there are: a few long texts go one by one.
            part = part[lengths[part] <= max(64, 4 * lengths[part[0]])]
            at += len(part)
            size, flat = self._windows([cells[i] for i in part], lengths[part]) if len(part) >= FEW else self._singly([cells[i] for i in part])
            sizes.append(size)
            flats.append(flat)
        return order, np.concatenate(sizes), np.concatenate(flats)

    def _singly(self, cells: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.encode(c), dtype=np.int32) for c in cells]
        return np.array([len(x) for x in ids], dtype=np.int64), np.concatenate(ids)

    def _windows(self, cells: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in ascending order of length, all read one symbol at a time.

        Column k of the window stands for the boundary k symbols back: its score, the trie node of the
        piece that is open since then, and a bitmap of the boundaries on its best path. Boundaries
        with open pieces survive; the latest one that is on the paths of all survivors is common, and
        ids up to it are given out. Only what lies after it is kept, 63 symbols at most; a text whose
        paths stay apart for longer is streamed singly.
        """
        rows, n, reach = len(cells), int(size.max()), self.longest
        code = np.frombuffer("".join(cells).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = np.arange(n) < size[:, None]
        codes = np.zeros((rows, n), dtype=np.uint32)
        codes[inside] = code
        score = np.full((rows, reach + 1), -np.inf)
        score[:, 0] = 0
        node = np.full((rows, reach + 1), -1, dtype=np.int32)
        path = np.zeros((rows, reach + 1), dtype=np.uint64)
        path[:, 0] = 1
        step, piece = np.zeros((rows, WINDOW), dtype=np.int64), np.zeros((rows, WINDOW), dtype=np.int64)
        base = np.zeros(rows, dtype=np.int64)
        ids = np.zeros((rows, n), dtype=np.int64)
        used = np.zeros((rows, n), dtype=bool)
        apart = np.zeros(rows, dtype=bool)
        one = np.uint64(1)
        for j in range(1, n + 1):
            lo = int(np.searchsorted(size, j))  # shorter texts are done
            for x in (score, node, path):
                x[lo:, 1:] = x[lo:, :-1]
            path[lo:, 1:] <<= one
            node[lo:, 1] = 0  # a piece may begin at every boundary
            here = codes[lo:, j - 1]
            symbol = self.symbol[here]
            r, k = np.nonzero(node[lo:] >= 0)
            k_live = k > 0
            r, k = r[k_live], k[k_live]
            after = self._step(node[lo + r, k], symbol[r])
            node[lo + r, k] = np.where(after > 0, after, -1)
            node[lo:, 0] = -1
            option = np.full((rows - lo, reach + 1), -np.inf)
            value = np.where(after > 0, self.node_score[after], -np.inf)
            option[r, k] = score[lo + r, k] + value
            single = np.zeros(rows - lo, dtype=bool)
            first = k == 1
            single[r[first]] = value[first] > -np.inf
            option[~single, 1] = score[lo:, 1][~single] + self.unknown
            best = reach - option[:, ::-1].argmax(axis=1)  # of equal scores the piece that begins earliest
            every = np.arange(rows - lo)
            score[lo:, 0] = option[every, best]
            path[lo:, 0] = path[lo + every, best] | one
            found = self.node_piece[np.maximum(node[lo + every, best], 0)].astype(np.int64)
            step[lo:, j % WINDOW] = best
            piece[lo:, j % WINDOW] = np.where((best == 1) & ~single, -1 - here.astype(np.int64), found)
            open_ = node[lo:] >= 0
            open_[:, 0] = False
            common = np.bitwise_and.reduce(np.where(open_, path[lo:], ~np.uint64(0)), axis=1) & path[lo:, 0]
            ended = size[lo:] == j
            common[ended] = one  # nothing is open at the end of the text
            back = np.bitwise_count((common & -common) - one).astype(np.int64)
            apart[lo:] |= j - base[lo:] >= WINDOW
            go = lo + np.flatnonzero((common > 0) & (j - back > base[lo:]) & ~apart[lo:])
            end = j - back[go - lo]
            live, e = go, end
            while len(live):
                begin = e - step[live, e % WINDOW]
                ids[live, begin], used[live, begin] = piece[live, e % WINDOW], True
                keep = begin > base[live]
                live, e = live[keep], begin[keep]
            base[go] = end
        sizes, flat = used.sum(axis=1), ids[used]
        if (flat < 0).any() or apart.any():
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for x in np.flatnonzero(apart):
                parts[x] = np.array(self.encode(cells[x]), dtype=np.int64)
            for x, p in enumerate(parts):
                if (p < 0).any():
                    parts[x] = np.array([i for q in p.tolist() for i in ([q] if q >= 0 else [self.byte_ids[b] for b in chr(-1 - q).encode()])])
            sizes, flat = np.array([len(p) for p in parts], dtype=np.int64), np.concatenate(parts)
        self.streamed += rows
        return sizes, flat.astype(np.int32)

    def stream(self, symbols: Iterable[str]) -> Iterator[list[int]]:
        """Ids in order, in chunks, each given out once no later symbol can change it.

        Only symbols after the last common boundary are held: at most the longest piece, and what
        the surviving paths disagree on.
        """
        window: list[str] = []  # symbols since the last common boundary
        score, back = [0.0], [(0, -1)]  # best path to each boundary; -1: an unknown symbol
        waiting: list[str] = []  # symbols whose pieces can still grow
        done = base = 0  # boundaries with all their successors entered

        def enter(text: str) -> None:
            """Pieces that begin at boundary ``done``; text is what follows it, as far as needed."""
            nonlocal done
            here, single = score[done], False
            for k in range(1, min(self.longest, len(text)) + 1):
                piece = text[:k]
                if piece not in self.found:
                    break
                hit = self.found[piece]
                if hit is not None:
                    put(done + k, here + hit[0], done, hit[1])
                    single |= k == 1
            if not single:
                put(done + 1, here + self.unknown, done, -1)
            done += 1

        def put(at: int, value: float, start: int, piece: int) -> None:
            while len(score) <= at:
                score.append(-np.inf)
                back.append((0, -1))
            if value > score[at]:
                score[at], back[at] = value, (start, piece)

        def commit(at: int) -> list[int]:
            nonlocal done, base
            ids: list[list[int]] = []
            i = at
            while i > 0:
                start, piece = back[i]
                ids.append([piece] if piece >= 0 else [self.byte_ids[b] for b in window[start].encode()])
                i = start
            del window[:at], score[:at], back[:at]
            score[:] = [s - score[0] for s in score]  # relative scores keep long texts exact
            back[:] = [(s - at, p) for s, p in back]
            back[0] = (0, -1)
            done -= at
            return [x for part in reversed(ids) for x in part]

        def common() -> int:
            """The last boundary on the paths to all boundaries that can still be continued."""
            ends = set(range(done, len(score)))
            while len(ends) > 1:
                last = max(ends)
                ends.remove(last)
                ends.add(back[last][0])
            return ends.pop()

        since = 0
        for symbol in symbols:
            waiting.append(symbol)
            window.append(symbol)
            since += 1
            if len(waiting) < self.longest:
                continue
            enter("".join(waiting))
            del waiting[0]
            if len(score) - 1 == done:  # no piece reaches beyond this boundary
                if done:
                    yield commit(done)
                since = 0
            elif since >= TRACE_EVERY:
                if at := common():
                    yield commit(at)
                since = 0
        while waiting:
            enter("".join(waiting))
            del waiting[0]
        if done:
            yield commit(done)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.stream(text) for i in part]

    def word(self, text: str) -> list[int]:
        """The same for a short text held whole."""
        n, found = len(text), self.found
        if text in found and n == 1 and found[text] is not None:
            return [found[text][1]]
        score = [0.0] + [-1e300] * n
        start, piece = [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, single = score[i], False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                part = text[i:j]
                if part not in found:
                    break
                hit = found[part]
                if hit is not None:
                    value = here + hit[0]
                    if value > score[j]:
                        score[j], start[j], piece[j] = value, i, hit[1]
                    if j == i + 1:
                        single = True
            if not single and here + self.unknown > score[i + 1]:
                score[i + 1], start[i + 1], piece[i + 1] = here + self.unknown, i, -1
        ids: list[int] = []
        while n:
            if piece[n] >= 0:
                ids.append(piece[n])
            else:
                ids += [self.byte_ids[b] for b in reversed(text[start[n]].encode())]
            n = start[n]
        return ids[::-1]


@lru_cache(maxsize=4)
def viterbi(path: str) -> Viterbi:
    return Viterbi(P.load(path))


_RUNS = re.compile(r" *[^ ]+| +")


class Known:
    """Ids of the words met so far, end to end in one array; it starts afresh when it is full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.slot)
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids])


def encode_texts(v: Viterbi, texts: list[str], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each text, and all ids. No piece crosses from a word into the next, so every
    word boundary is one on which all paths converge: words are streamed by themselves, many at once,
    and remembered."""
    cut = [_cells(v, t) for t in texts]
    if len(known.slot) > REMEMBERED:
        known.clear()
    missing = list(set().union(*cut) - known.slot.keys())
    order, sizes, ids = v.words([P.SPACE + w.replace(" ", P.SPACE) for w in missing])
    known.add([missing[i] for i in order], sizes, ids)
    slots = np.fromiter(
        (s for c in cut for s in map(known.slot.__getitem__, c)), dtype=np.int64, count=sum(map(len, cut))
    )
    size, ends = known.size[slots], np.cumsum([0, *map(len, cut)])
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(total[-1])) + np.repeat(known.start[slots] - total[:-1], size)
    return np.diff(total[ends]), known.ids[at]


def _cells(v: Viterbi, text: str) -> list[str]:
    """Words with the spaces before them, less the first space."""
    if not v.dummy_prefix:
        raise ValueError("models without a dummy prefix are not supported")
    if not text:
        return []
    cut = text.replace(P.SPACE, " ").split(" ")
    return cut if "" not in cut else [t[1:] for t in _RUNS.findall(" " + " ".join(cut))]


def encode_text(v: Viterbi, text: str) -> np.ndarray:
    return encode_texts(v, [text], Known())[1]


def decode_ids(v: Viterbi, ids: np.ndarray) -> str:
    text = b"".join(map(v.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(P.SPACE, " ")
    return text[1:] if v.dummy_prefix and text.startswith(" ") else text


def _carried(docs: DataFrame, carry: tuple[str, ...]) -> tuple[list[Column], str, dict[str, str]]:
    """Columns to carry under names of our own, their types, and the way back."""
    kept = [f"_c_{i}" for i in range(len(carry))]
    types = "".join(f", {k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(carry, kept, strict=True))
    return [F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)], types, dict(zip(kept, carry, strict=True))


def _id_lists(sizes: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))


def encoded(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """id, ids (array<int>) and ``carry`` for every row.

    Null and empty texts have no ids. Rows are encoded by themselves: repeated rows, ties and null
    ids pass through, other columns are ignored, an empty table gives no rows. Ties between
    segmentations go to the piece that begins earlier, as in the library's unigram models. Characters
    without a piece become byte pieces, so decoding restores every text but for the space symbol
    U+2581 itself, which the model cannot tell from a space.
    """
    private_names(docs, id_col, text_col, *carry)
    kind = docs.schema[id_col].dataType.simpleString()
    columns, types, back = _carried(docs, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = viterbi(model_path)
        known = Known()
        for batch in batches:
            for start, end in byte_ranges(batch.column(2)):
                part = batch.slice(start, end - start)
                sizes, flat = encode_texts(v, [t or "" for t in part.column(1).to_pylist()], known)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _id_lists(sizes, flat)] + [part.column(3 + i) for i in range(len(back))], ["_id", "ids", *back]
                )

    source = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).alias("_bytes"),
        *columns,
    )
    return source.mapInArrow(run, f"_id {kind}, ids array<int>{types}").withColumnsRenamed({"_id": id_col} | back)


def decoded(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text for every row of ids; null ids decode to the empty text.

    Repeated rows are decoded each by itself, no rows give none; other columns are ignored, so clashing names do no harm.
    """
    private_names(rows, id_col, ids_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = viterbi(model_path)
        for batch in batches:
            for start, end in byte_ranges(batch.column(2)):
                part = batch.slice(start, end - start)
                texts = [decode_ids(v, np.array(x or [], dtype=np.int32)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    source = rows.select(
        F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"), (F.coalesce(F.size(ids_col), F.lit(0)) * 4).alias("_bytes")
    )
    return source.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def checked(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_ids, ids, ids_sha256 and round_trip for every row, as ``encoded`` gives the ids.

    The ids are decoded again in the batches where they are made. ``ids_sha256`` is over the ids as
    little-endian 32-bit integers; round_trip says that decoding gives the text back (with U+2581 as a
    space; null as the empty text). Repeated rows give equal rows, no rows give none; other columns are ignored.
    """
    private_names(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        v = viterbi(model_path)
        known = Known()
        for batch in batches:
            for start, end in byte_ranges(batch.column(2)):
                part = batch.slice(start, end - start)
                digests, same = [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                sizes, flat = encode_texts(v, texts, known)
                for t, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                    digests.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                    same.append(decode_ids(v, ids) == t.replace(P.SPACE, " "))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), _id_lists(sizes, flat), pa.array(digests), pa.array(same)],
                    ["_id", "n_bytes", "n_ids", "ids", "ids_sha256", "round_trip"],
                )

    source = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    out = source.mapInArrow(run, f"_id {kind}, n_bytes long, n_ids long, ids array<int>, ids_sha256 string, round_trip boolean")
    return out.withColumnRenamed("_id", id_col)
