"""Vectors in blocks of rows, and the block join that finds nearest neighbours.

A block is one row: keys, filter codes and vectors as bytes. Blocks of queries meet blocks of chunks,
so that vectors are compared by matrix products, a pair of blocks at a time, and no vector goes through the
driver. Where vectors lie in lists, a block of chunks says the list of each of its vectors and a block of queries,
in a bit a list, which lists each of its queries searches: a query is sent once, however many lists it searches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers of a block of chunks and of queries (1 MB and 512 kB).
CHUNK_BLOCK = 1 << 18
QUERY_BLOCK = 1 << 16
#: Numbers of all queries together up to which their blocks are broadcast (32 MB); more meet chunks by a shuffle.
BROADCAST_NUMBERS = 1 << 22
#: Parts into which chunks are dealt out when blocks meet by a shuffle.
GROUPS = 64
#: Distances that are held at once (8 MB).
SLICE = 1 << 20
#: Candidates that a task holds before it lets them go.
HELD = 1 << 21
#: Filter code of chunks that no filter picks.
OTHER = 255
#: Distances are told apart to this many digits; products of equal vectors may differ beyond them.
DIGITS = 12

#: ``meet`` is 0 in all blocks: what an equality join goes by. ``lists`` are the lists of a block, ``places`` what
#: each of its vectors has to do with them (an int each, or bits of all lists); both are null where all meet all.
BLOCK = "meet int, dim int, n int, keys binary, codes binary, vectors binary, places binary, lists array<int>"


def usable(name: str) -> Column:
    """Whether there is a vector without nulls."""
    return (F.size(name) > 0) & ~F.exists(name, lambda x: x.isNull())


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows; lengths that differ are an error."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError(f"vectors of {lengths.min()} and of {lengths.max()} numbers in one collection")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def packed(rows: DataFrame, numbers: int, n_lists: int = 0) -> DataFrame:
    """Blocks of at most ``numbers`` numbers from rows (key, code, vector, and lists where vectors have them).

    ``lists`` holds as many ints in every row: the one list of a chunk, or, with ``n_lists``, the lists that a query
    searches. Neighbours in a partition share blocks, so rows should lie sorted by list.
    """
    listed = "lists" in rows.columns
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
    names = ["meet", "dim", "n", "keys", "codes", "vectors", "places", "lists"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = matrix(batch.column(2))
            step = max(1, numbers // v.shape[1])
            for at in range(0, len(batch), step):
                to = min(at + step, len(batch))
                part = v[at:to] if v.dtype == np.float32 else v[at:to].astype(np.float64)
                places = own = None
                if listed:
                    lists = matrix(batch.column(3)[at:to]).astype(np.int32)
                    own, places = np.unique(lists), lists
                    if n_lists:
                        bits = np.zeros((to - at, n_lists), bool)
                        np.put_along_axis(bits, lists, True, axis=1)
                        places = np.packbits(bits, axis=1)
                values = (
                    0, v.shape[1], to - at, batch.column(0)[at:to].to_numpy().astype(np.int64).tobytes(),
                    batch.column(1)[at:to].to_numpy().astype(np.uint8).tobytes(), np.ascontiguousarray(part).tobytes(), None if places is None else places.tobytes(), own,
                )
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], names)

    columns = [F.col("key").cast("long"), F.col("code").cast("int"), F.col("vector"), *([F.col("lists")] if listed else [])]
    return rows.select(*columns).mapInArrow(pack, BLOCK)


def codes(column: Column, filters: list[str]) -> Column:
    """The place of a value in the list of filters."""
    out = F.lit(OTHER)
    for i, value in enumerate(filters):
        out = F.when(column == value, i).otherwise(out)
    return out


def _vectors(n: int, dim: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if q.shape[1] != c.shape[1]:
        raise ValueError(f"a query of {q.shape[1]} numbers meets vectors of {c.shape[1]}")
    products = q @ c.T
    if metric == "cosine":
        lengths = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1))
        lengths += 1e-9
        products /= lengths
        return np.subtract(1, products, out=products)
    return (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * products


def _searched(q: np.ndarray, c: np.ndarray, metric: str, wanted: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distances of queries and the vectors of lists that they search (``wanted``: by list), NaN elsewhere; vectors lie in runs of one list."""
    out = np.full((len(q), len(c)), np.nan)
    edges = np.flatnonzero(np.diff(own)) + 1
    for a, b in zip([0, *edges], [*edges, len(own)], strict=True):
        rows = np.flatnonzero(wanted[:, own[a]])
        if len(rows):
            out[rows, a:b] = distances(q[rows], c[a:b], metric)
    return out


class Nearest:
    """The k nearest of each query of a block so far: rows, keys and distances side by side."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.dist = np.zeros(0)
        self.worst: np.ndarray | None = None

    def add(self, d: np.ndarray, keys: np.ndarray) -> None:
        if not d.shape[1]:
            return
        bar = np.partition(d, self.k - 1, axis=1)[:, self.k - 1] if d.shape[1] > self.k else np.full(len(d), np.inf)
        bar = np.where(np.isnan(bar), np.inf, bar)  # fewer than k that count
        if self.worst is not None:
            bar = np.minimum(bar, self.worst)
        rows, at = np.nonzero(d <= (bar + 10.0**-DIGITS)[:, None])
        rows, keys = np.concatenate([self.rows, rows]), np.concatenate([self.keys, keys[at]])
        dist = np.concatenate([self.dist, np.round(d[rows[len(self.rows) :], at], DIGITS)])
        order = np.lexsort((keys, dist, rows))
        rows, keys, dist = rows[order], keys[order], dist[order]
        counts = np.bincount(rows, minlength=len(d))
        first = np.cumsum(counts) - counts
        nth = np.arange(len(rows)) - first[rows]
        kept = nth < self.k
        self.rows, self.keys, self.dist = rows[kept], keys[kept], dist[kept]
        self.worst = np.full(len(d), np.inf)
        last = nth == self.k - 1
        self.worst[rows[last]] = dist[last]


def met(query_blocks: DataFrame, chunk_blocks: DataFrame, k: int, branches: list[int | None], metric: str, numbers: int, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """query_id, branch, chunk_key, dist, rank: of the chunks (in lists: those of a query's lists) the k nearest in each branch.

    A branch takes the chunks of one filter code, or all (None). ``numbers`` says how many numbers the query
    blocks hold: up to a bound they are broadcast and chunks stay where they are; beyond it the chunk
    blocks are dealt out over groups, each of which all query blocks go to. Blocks without a list in common do not
    meet. Each task keeps the best candidates of the query blocks it has seen; these meet in two rounds.
    """
    q = query_blocks.select(*[F.col(c).alias(f"q_{c}") for c in query_blocks.columns if c != "codes"])
    c = chunk_blocks.select(*[F.col(x).alias(f"c_{x}") for x in chunk_blocks.columns])
    shared = F.coalesce(F.arrays_overlap("c_lists", "q_lists"), F.lit(True))
    if numbers <= broadcast_numbers:
        pairs = c.join(F.broadcast(q), (F.col("c_meet") == F.col("q_meet")) & shared)
    else:
        c = c.withColumn("c_group", F.pmod(F.xxhash64("c_keys"), F.lit(GROUPS)).cast("int"))
        q = q.withColumn("q_group", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
        pairs = c.hint("shuffle_merge").join(q, (F.col("c_meet") == F.col("q_meet")) & (F.col("c_group") == F.col("q_group")) & shared)
    found = pairs.select("q_dim", "q_n", "q_keys", "q_vectors", "q_places", "c_dim", "c_n", "c_keys", "c_codes", "c_vectors", "c_places").mapInArrow(
        _compared(k, branches, metric), "query_id long, branch int, chunk_key long, dist double"
    )
    # Tasks may be many: their candidates meet in parts before they meet in one place.
    part = Window.partitionBy("query_id", "branch", "_part").orderBy("dist", "chunk_key")
    found = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    whole = Window.partitionBy("query_id", "branch").orderBy("dist", "chunk_key")
    return found.drop("_part").withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def _compared(k: int, branches: list[int | None], metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[Nearest]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for own, best in held.items():
                ids = np.frombuffer(own, dtype=np.int64)
                for branch, x in enumerate(best):
                    if len(x.rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[x.rows]), pa.array(np.full(len(x.rows), branch, np.int32)), pa.array(x.keys), pa.array(x.dist)],
                            ["query_id", "branch", "chunk_key", "dist"],
                        )
            held.clear()

        for batch in batches:
            for i in range(len(batch)):
                q_dim, q_n, q_keys, q_vectors, q_places, c_dim, c_n, c_keys, c_codes, c_vectors, c_places = (batch.column(j)[i].as_py() for j in range(11))
                if q_keys not in held:
                    if sum(len(x.rows) for best in held.values() for x in best) + k * q_n * len(branches) > HELD:
                        yield from out()
                    held[q_keys] = [Nearest(k) for _ in branches]
                q, c = _vectors(q_n, q_dim, q_vectors), _vectors(c_n, c_dim, c_vectors)
                keys, code = np.frombuffer(c_keys, dtype=np.int64), np.frombuffer(c_codes, dtype=np.uint8)
                if c_places is not None:
                    wanted = np.unpackbits(np.frombuffer(q_places, dtype=np.uint8).reshape(q_n, -1), axis=1)
                    own = np.frombuffer(c_places, dtype=np.int32)
                step = max(1, SLICE // q_n)
                for at in range(0, c_n, step):
                    part = slice(at, at + step)
                    d = distances(q, c[part], metric) if c_places is None else _searched(q, c[part], metric, wanted, own[part])
                    for branch, best in zip(branches, held[q_keys], strict=True):
                        mine = slice(None) if branch is None else np.flatnonzero(code[part] == branch)
                        best.add(d[:, mine], keys[part][mine])
            del batch  # before the next one comes
        yield from out()

    return run
