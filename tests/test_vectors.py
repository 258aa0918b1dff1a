"""Block search against brute force, and the inverted file against exact search."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwell.operators import retrieval, vector_blocks, vector_index

SCHEMA = "chunk_key long, embedding array<float>, source_type string"
KINDS = ["statute", "manual", "verdict"]


def table(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in v], KINDS[i % 3]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def asked(chunks, every):
    return chunks.where(F.col("chunk_key") % every == 0).select(F.col("chunk_key").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def vectors():
    v = np.random.default_rng(5).normal(size=(700, 12)).astype(np.float32)
    v[300:340] = v[299]  # ties, which keys break
    return v


def brute(vectors, ids, k, kind=None, metric="cosine"):
    v = vectors.astype(np.float64)
    out = []
    for q in ids:
        p = v @ v[q]
        d = 1 - p / (np.sqrt((v * v).sum(1)) * np.sqrt(v[q] @ v[q]) + 1e-9) if metric == "cosine" else ((v - v[q]) ** 2).sum(1)
        own = [i for i in range(len(v)) if kind is None or KINDS[i % 3] == kind]
        out += [(q, i, r + 1) for r, i in enumerate(sorted(own, key=lambda i: (round(d[i], 9), i))[:k])]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2sq"])
@pytest.mark.parametrize("shuffled", [False, True])
def test_block_search_equals_brute_force(spark, vectors, metric, shuffled, monkeypatch):
    monkeypatch.setattr(vector_blocks, "CHUNK_BLOCK", 12 * 37)
    monkeypatch.setattr(vector_blocks, "QUERY_BLOCK", 12 * 5)
    monkeypatch.setattr(vector_blocks, "HELD", 200)
    if shuffled:
        monkeypatch.setattr(vector_blocks.met, "__defaults__", (0,))
    c = table(spark, vectors)
    got = retrieval.topk(asked(c, 23), c, 7, [None, "manual"], metric).collect()
    ids = list(range(0, 700, 23))
    for branch, kind in enumerate((None, "manual")):
        own = [(r["query_id"], r["chunk_key"], r["rank"]) for r in got if r["branch"] == branch]
        assert sorted(own) == sorted(brute(vectors, ids, 7, kind, metric))


def test_chunks_are_read_once_for_all_branches(spark, vectors, tmp_path):
    path = str(tmp_path / "chunks")
    table(spark, vectors).write.parquet(path)
    chunks = spark.read.parquet(path)
    found = retrieval.topk(asked(table(spark, vectors), 100), chunks, 3, [None, "statute", "manual"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("chunks]") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lengths_that_differ_fail(spark):
    c = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "chunk_key long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="numbers"):
        retrieval.knn(q, c.repartition(1), 2).collect()
    with pytest.raises(Exception, match="numbers"):
        retrieval.knn(q, c.where("chunk_key = 1"), 2).collect()


def test_no_queries_and_no_chunks(spark, vectors):
    c = table(spark, vectors)
    assert retrieval.knn(asked(c.where("false"), 1), c, 3).count() == 0
    assert retrieval.knn(asked(c, 50), c.where("false"), 3).count() == 0
    assert vector_index.search(vector_index.built(c.where("false")), asked(c, 50), 3).count() == 0


@pytest.fixture(scope="module")
def crowd():
    """Loose groups of several sizes; a third of the vectors is one vector."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    v = np.concatenate([centres[rng.integers(0, 40, 4000)] + 0.9 * rng.normal(size=(4000, 16)), np.tile(centres[0], (2000, 1))])
    return v.astype(np.float32)


def test_the_index_recalls_and_can_be_exact(spark, crowd, tmp_path):
    c = table(spark, crowd)
    q = asked(c, 17)
    index = vector_index.built(c, filters=("manual",), sample=2000)
    assert index.blocks.agg(F.sum("n")).first()[0] == len(crowd) and index.probes < 0.6 * len(index.centroids)
    exact = retrieval.topk(q, c, 10, [None, "manual"]).cache()
    found = vector_index.search(index, q, 10, (None, "manual"))
    # Equal vectors are as good as each other: distances are compared.
    far = exact.groupBy("query_id", "branch").agg(F.max("dist").alias("far"))
    good = found.join(far, ["query_id", "branch"]).where("dist <= far").count()
    assert good >= 0.9 * exact.count()
    whole = vector_index.search(index, q, 10, (None, "manual"), probes=len(index.centroids))
    assert whole.exceptAll(exact).isEmpty() and exact.exceptAll(whole).isEmpty()
    vector_index.saved(index, str(tmp_path / "index"))
    again = vector_index.search(vector_index.opened(spark, str(tmp_path / "index")), q, 10, (None, "manual"))
    assert again.exceptAll(found).isEmpty()


def test_the_index_grows(spark, crowd):
    c = table(spark, crowd[:3000])
    index = vector_index.built(c, sample=1000)
    index = vector_index.extended(index, table(spark, crowd[3000:], first=3000))
    q = asked(table(spark, crowd[3000:], first=3000), 50)
    found = vector_index.search(index, q, 1).where("dist < 1e-6")
    assert index.blocks.agg(F.sum("n")).first()[0] == len(crowd) and found.count() == q.count()


def test_recall_on_the_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_key"), "embedding")
    q = e.where("chunk_key % 20 = 0").select(F.col("chunk_key").alias("query_id"), "embedding")
    found = vector_index.search(vector_index.built(e), q, 10)
    r = vector_index.recall(found, retrieval.topk(q, e, 10, [None])).first()
    assert r["n_found"] >= 0.9 * r["n_exact"] > 0


@pytest.mark.parametrize("broadcast", [False, True])
def test_a_query_is_sent_once_however_many_lists_it_searches(spark, crowd, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(vector_blocks.met, "__defaults__", (0,))
    monkeypatch.setattr(vector_blocks, "QUERY_BLOCK", 16 * 50)
    sent = []
    met = vector_blocks.met
    monkeypatch.setattr(vector_blocks, "met", lambda q, *more: sent.append(q) or met(q, *more))
    own_vectors = crowd[:4000]  # without the copies, whose lists are ties
    c = table(spark, own_vectors)
    q = asked(c, 17)
    index = vector_index.built(c, sample=1000)
    found = {n: vector_index.search(index, q, 5, probes=n) for n in (1, 20)}
    assert [x.agg(F.sum("n")).first()[0] for x in sent] == [q.count()] * 2
    # Each of its lists is searched, and no other.
    v = own_vectors.astype(np.float64)
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-9
    to = ((v[:, None, :] - index.centroids) ** 2).sum(axis=2)
    own = to.argmin(axis=1)
    for n, rows in found.items():
        got = {}
        for r in rows.collect():
            got.setdefault(r["query_id"], []).append(r["dist"])
        for i, dist in got.items():
            near = np.isin(own, np.argsort(to[i], kind="stable")[:n])
            assert np.allclose(sorted(dist), np.sort(1 - v[near] @ v[i])[:5], atol=1e-6)


def test_memory_of_a_pair_of_blocks_is_bounded():
    rng, q_n, c_n = np.random.default_rng(2), 1024, 8192
    q, c = rng.normal(size=(q_n, 16)).astype(np.float32), rng.normal(size=(c_n, 16)).astype(np.float32)
    keys = np.arange(c_n, dtype=np.int64)
    row = [16, q_n, keys[:q_n].tobytes(), q.tobytes(), None, 16, c_n, keys.tobytes(), np.zeros(c_n, np.uint8).tobytes(), c.tobytes(), None]
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in row], [str(i) for i in range(len(row))])
    tracemalloc.start()
    found = list(vector_blocks._compared(5, [None, 0], "cosine")(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x) for x in found) == 2 * 5 * q_n and peak < 48 << 20  # all distances at once are 64 MB
