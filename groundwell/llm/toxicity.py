"""Toxicity by a chain of linear classifiers over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import private_names
from .textbytes import LETTERS, buffers, lower_ascii, mix, prefix_hash, slices, span_hash, words

#: Labelled texts used for fitting, at most: those whose ids have the smallest digests.
SAMPLE = 8000
BUCKET_BITS = 18
#: Words that each model looks at, chosen by chi-squared on its own training rows.
FEATURES = 400
LEAST_TEXTS = 5
FOLDS = 5
RIDGE = 0.3
#: One text of the sample has no more features than there are buckets.
BUCKETS = 1 << BUCKET_BITS


#: Beginnings of longer words (in bytes) that are features beside whole words: forms of one word share them.
BEGINNINGS = (5, 8)


def bucket_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct buckets of each text's words and of their beginnings, ascending. Words are runs of letters, in small ASCII."""
    raw, offsets = buffers(column)
    for i, j in slices(offsets):
        part = offsets[i : j + 1] - offsets[i]
        data = lower_ascii(raw[offsets[i] : offsets[j]])
        starts, ends, counts = words(data, part, LETTERS)
        sums, rows = prefix_hash(data), np.repeat(np.arange(j - i), counts)
        hashes, owners = [span_hash(sums, starts, ends)], [rows]
        for n in BEGINNINGS:
            long = ends - starts > n
            hashes.append(span_hash(sums, starts[long], starts[long] + n) ^ np.uint64(n << 32))
            owners.append(rows[long])
        # Only the high bits make the bucket: the lengths of beginnings are mixed into them.
        bucket = (mix(np.concatenate(hashes)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        pairs = np.unique(np.concatenate(owners) * BUCKETS + bucket)
        at = np.searchsorted(pairs, np.arange(j - i + 1) * BUCKETS)
        for k in range(j - i):
            yield pairs[at[k] : at[k + 1]] % BUCKETS


@dataclass
class Linear:
    """One model of the chain: word weights, weights of earlier categories' probabilities, bias."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def score(self, hits: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(hits @ self.weights + earlier @ self.earlier + self.bias, -30, 30)))


def _dense(sets: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(buckets)))
    if len(buckets):
        for row, s in zip(x, sets, strict=True):
            at = np.searchsorted(buckets, s)
            at[at == len(buckets)] = 0
            row[at[buckets[at] == s]] = 1
    return x


def _informative(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    there = np.bincount(np.concatenate([*sets, np.zeros(0, dtype=np.int64)]), minlength=BUCKETS).astype(float)
    hits = [s for s, v in zip(sets, y, strict=True) if v]
    both = np.bincount(np.concatenate([*hits, np.zeros(0, dtype=np.int64)]), minlength=BUCKETS).astype(float)
    n, positive = len(y), y.sum()
    expected = there * positive / n
    spread = np.maximum(expected * (1 - there / n) * (1 - positive / n), 1e-9)
    value = np.where(there >= LEAST_TEXTS, (both - expected) ** 2 / spread, -1)
    best = np.argsort(-value, kind="stable")[:FEATURES]
    return np.sort(best[value[best] > 0])


def fit(sets: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Ridge-penalised logistic regression by Newton steps. One class only gives a constant."""
    none = np.zeros(0, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Linear(none, np.zeros(0), np.zeros(earlier.shape[1]), 30.0 if rate == 1 else -30.0)
    buckets = _informative(sets, y)
    x = np.hstack([_dense(sets, buckets), earlier, np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        curve = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), gradient)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    k = len(buckets)
    return Linear(buckets, w[:k], w[k:-1], float(w[-1]))


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """One model per column of ``labels`` (NaN: not labelled). Later models are fitted on the
    earlier categories' out-of-fold probabilities, so that they see what they will see on new texts."""
    chain: list[Linear] = []
    earlier = np.zeros((len(sets), 0))
    for column in labels.T:
        known = ~np.isnan(column)

        def part(rows: np.ndarray, earlier=earlier, column=column) -> Linear:
            at = np.flatnonzero(rows)
            return fit([sets[i] for i in at], earlier[at], column[at])

        out = np.zeros(len(sets))
        for f in range(FOLDS):
            rest = folds == f
            m = part(known & ~rest)
            at = np.flatnonzero(rest)
            out[at] = m.score(_dense([sets[i] for i in at], m.buckets), earlier[at])
        chain.append(part(known))
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word sets, labels and folds of the bounded sample; a fold is a residue of the id's digest.

    Ids that come more than once, in labels or documents, give a row for each meeting; all of them share a fold.
    Labels without a document, and null ids, give none.
    """
    kinds = [c.cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())]
    chosen = (
        labels.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), *kinds, F.xxhash64(F.col(id_col)).alias("_h"))
        .orderBy("_h", "_id")
        .limit(SAMPLE)
    )
    names = [f"y{i}" for i in range(len(categories))]
    texts = docs.select(F.col(id_col).alias("_id"), F.col("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.astype(np.int32) for s in bucket_sets(batch.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], sets], ["_id", "_h", *names, "s"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = texts.select("_id", "_text", "_h", *names)
    schema = f"_id {kind}, _h long, {''.join(f'{n} double, ' for n in names)}s array<int>"
    rows = source.mapInArrow(run, schema).toArrow().sort_by([("_h", "ascending"), ("_id", "ascending")])
    sets = [np.array(s, dtype=np.int64) for s in rows["s"].to_pylist()]
    values = [rows[n].to_numpy().astype(float) for n in names]
    y = np.array(values).T if sets else np.zeros((0, len(names)))
    return sets, y, rows["_h"].to_numpy() % FOLDS


def scored(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float | dict[str, float] = 0.5,
) -> DataFrame:
    """id, p_<category> and is_<category> for every row of ``docs``, in the order of the chain.

    Null text counts as empty. Rows are scored one by one: repeated rows get equal scores. Labels
    that are null are left out of their category; labels of one class only, or none, give the
    constant 0 or 1 of that class (0 for none). ``threshold`` is one for all categories, or by category
    (0.5 for those not given). Of the labelled rows at most ``SAMPLE`` are used for
    fitting; every row of ``docs`` is scored on its whole text. Empty tables give no rows.
    """
    private_names(docs, id_col, text_col)
    private_names(labels, id_col)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    chain = fit_chain(*training_rows(texts, labels, categories, id_col))
    shared = spark.sparkContext.broadcast(chain)  # a few hundred weights a category
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        every = np.unique(np.concatenate([m.buckets for m in models]))
        at = [np.searchsorted(every, m.buckets) for m in models]
        for batch in batches:
            out: list[np.ndarray] = []
            pending: list[np.ndarray] = []

            def flush(pending=pending, out=out) -> None:
                x = _dense(pending, every)
                p = np.zeros((len(pending), 0))
                for m, cols in zip(models, at, strict=True):
                    p = np.hstack([p, m.score(x[:, cols], p)[:, None]])
                out.append(p)
                pending.clear()

            for s in bucket_sets(batch.column(1)):
                pending.append(s)
                if len(pending) == 512:
                    flush()
            flush()
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in p.T]], ["_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    result = texts.mapInArrow(run, f"_id {kind}, {', '.join(f'{n} double' for n in names)}")
    return result.select(
        F.col("_id").alias(id_col), *names, *[(F.col(f"p_{c}") >= (threshold.get(c, 0.5) if isinstance(threshold, dict) else threshold)).alias(f"is_{c}") for c in categories]
    )
