"""An inverted file of vectors: lists around centroids, searched by their nearest few (J1, approximate)."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from . import vector_blocks as vb

#: Vectors that centroids are fitted on: those whose keys have the smallest digests. All vectors are indexed.
SAMPLE = 16_384
MOST_LISTS = 1024
STEPS = 12
#: Neighbours of sampled vectors that the lists searched must hold, measured when the index is fitted.
TARGET = 0.97
#: Parts into which the vectors of a list are dealt out while the index is built.
SALTS = 16


@dataclass(frozen=True)
class Index:
    """Centroids, how many lists a query searches, and all vectors in blocks by list."""

    centroids: np.ndarray
    probes: int
    filters: tuple[str, ...]
    metric: str
    blocks: DataFrame


def _placed(v: np.ndarray, metric: str) -> np.ndarray:
    v = v.astype(np.float64)
    return v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-9) if metric == "cosine" else v


def _centroids(v: np.ndarray, lists: int) -> np.ndarray:
    """Means of the sample's vectors around the first ones, a few steps on; empty lists stay where they are."""
    c = v[:lists].copy()
    for _ in range(STEPS):
        own = np.argmin(vb.distances(v, c, "l2sq"), axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        n = np.bincount(own, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def _probes(v: np.ndarray, c: np.ndarray, k: int, target: float) -> int:
    """The fewest lists that hold the wanted share of the true neighbours of sampled vectors in the sample."""
    asked = v[:: max(1, len(v) // 256)]
    own = np.argmin(vb.distances(v, c, "l2sq"), axis=1)
    k = min(k, len(v) - 1)
    if k < 1:
        return 1
    near = np.argsort(vb.distances(asked, v, "l2sq"), axis=1, kind="stable")[:, 1 : k + 1]  # the nearest is itself
    order = np.argsort(np.argsort(vb.distances(asked, c, "l2sq"), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def _lists(centroids: np.ndarray, probes: int, metric: str):
    @F.arrow_udf("array<int>")
    def lists(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        d = vb.distances(_placed(vb.matrix(vectors), metric), centroids, "l2sq")
        near = np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel()))

    return lists


def _blocks(rows: DataFrame, centroids: np.ndarray, probes: int, metric: str, key: str, code: Column, numbers: int, parts: int | None = None) -> DataFrame:
    """Blocks of vectors and their nearest lists: one of a chunk, which are sorted by it; those that a query searches, in ``parts`` partitions."""
    near = rows.select(F.col(key).alias("key"), code.alias("code"), F.col("embedding").alias("vector"), _lists(centroids, probes, metric)(F.col("embedding")).alias("lists"))
    own, salt = F.get("lists", F.lit(0)), F.pmod(F.xxhash64("key"), F.lit(SALTS))
    dealt = near.repartition(own, salt) if parts is None else near.repartition(parts, own, salt)
    return vb.packed(dealt.sortWithinPartitions(own), numbers, 0 if parts is None else len(centroids))


def built(
    chunks: DataFrame, filters: tuple[str, ...] = (), metric: str = "cosine", k: int = 10, lists: int | None = None, target: float = TARGET, sample: int = SAMPLE
) -> Index:
    """An index of all usable vectors of chunks (chunk_key, embedding, and source_type where there are filters).

    Lists number about the square root of the vectors. Centroids and the number of lists a query searches
    are fitted on ``sample`` vectors at most; so a sampled vector finds ``target`` of its k neighbours. A list may
    hold any number of vectors: its blocks are dealt out. No vectors give an index that finds nothing.
    """
    pool = chunks.where(vb.usable("embedding"))
    n = pool.count()
    taken = pool.select("chunk_key", "embedding").orderBy(F.xxhash64("chunk_key"), "chunk_key").limit(sample).select("embedding").toArrow()
    if not n:
        return Index(np.zeros((0, 0)), 1, filters, metric, chunks.sparkSession.createDataFrame([], vb.BLOCK))
    v = _placed(vb.matrix(taken.column(0).combine_chunks()), metric)
    centroids = _centroids(v, min(len(v), lists or min(MOST_LISTS, max(1, int(n**0.5)))))
    index = Index(centroids, _probes(v, centroids, k, target), filters, metric, pool)
    return replace(index, blocks=storage.stored(_indexed(index, pool)))


def _indexed(index: Index, pool: DataFrame) -> DataFrame:
    code = vb.codes(F.col("source_type"), list(index.filters)) if index.filters else F.lit(vb.OTHER)
    return _blocks(pool, index.centroids, 1, index.metric, "chunk_key", code, vb.CHUNK_BLOCK)


def extended(index: Index, chunks: DataFrame) -> Index:
    """The index with more chunks, whose vectors go to the lists there are."""
    more = _indexed(index, chunks.where(vb.usable("embedding")))
    return replace(index, blocks=index.blocks.unionByName(storage.stored(more)))


def search(index: Index, queries: DataFrame, k: int, branches: tuple[str | None, ...] = (None,), probes: int | None = None) -> DataFrame:
    """query_id, branch, chunk_key, dist, rank: the nearest of the lists searched, by their true distances.

    With as many ``probes`` as lists the result is exact.
    """
    asked = storage.stored(queries.where(vb.usable("embedding")).select("query_id", "embedding").dropDuplicates(["query_id"]))
    if not len(index.centroids):
        return vb.met(queries.sparkSession.createDataFrame([], vb.BLOCK), index.blocks, k, [None], index.metric, 0)
    probes = min(probes or index.probes, len(index.centroids))
    numbers = asked.agg(F.sum(F.size("embedding"))).first()[0] or 0
    q = _blocks(asked, index.centroids, probes, index.metric, "query_id", F.lit(0), vb.QUERY_BLOCK, -(-numbers // vb.QUERY_BLOCK) or 1)
    places = [None if b is None else index.filters.index(b) for b in branches]
    return vb.met(q, index.blocks, k, places, index.metric, numbers)


def saved(index: Index, path: str) -> None:
    """Blocks by list and, beside them, the centroids."""
    spark = index.blocks.sparkSession
    index.blocks.write.parquet(f"{path}/blocks")
    rows = [(i, [float(x) for x in c], index.probes, list(index.filters), index.metric) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>, probes int, filters array<string>, metric string").coalesce(1).write.parquet(f"{path}/centroids")


def opened(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
    c = np.array([r["centroid"] for r in rows])
    return Index(c, rows[0]["probes"], tuple(rows[0]["filters"]), rows[0]["metric"], spark.read.parquet(f"{path}/blocks"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_exact and n_found: how many of the exact neighbours (query_id, branch, chunk_key) were found."""
    hit = found.select("query_id", "branch", "chunk_key").withColumn("_hit", F.lit(1).cast("long"))
    return exact.join(hit, ["query_id", "branch", "chunk_key"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("n_found"))
