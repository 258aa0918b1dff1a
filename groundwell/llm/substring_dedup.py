"""Removal of long repeated substrings: anchors bring candidates together, merged transforms decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import bwt_merge
from .runtime import checkpointed, private_names, stored
from .textbytes import buffers, gram_hashes, mix, prefix_hash, slices, span_hash

LENGTH = 200
#: Anchors are the least hashes of GRAM-byte strings among those of each window of LENGTH bytes.
GRAM = 104
REACH = LENGTH - GRAM  # windows that hold an anchor begin at most this far before it
BLOCK = 100
#: A window reaches this far beyond its anchor's gram on one side at least.
SIDE = REACH // 2
#: Snippets of one anchor merged by one task; more of them go by window digests instead.
GROUP = 1000
SHARD_BYTES = 1 << 17
CHUNK_BYTES = 1 << 20
#: Rows of two numbers that are broadcast at most (some 25 MB).
BROADCAST_IDS = 500_000


def _sliding(x: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours."""
    f = np.minimum if low else np.maximum
    have = 1
    while have < width:
        step = min(have, width - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def _places(cs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's anchors and hashes of their grams."""
    h = gram_hashes(cs, GRAM)
    least = _sliding(h, REACH + 1, True)
    edge = np.zeros(REACH, dtype=np.uint64)
    greatest = _sliding(np.concatenate([edge, least, edge]), REACH + 1, False)
    place = np.flatnonzero(greatest == h)
    return place, h[place]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes of their grams and of their snippets, for a text of at least LENGTH bytes.

    Equal windows have equal anchors at equal places, so every window that occurs twice has an
    anchor that occurs twice.
    """
    cs = prefix_hash(data)
    n = len(data)
    place, h = _places(cs)
    start, end = np.maximum(place - REACH, 0), np.minimum(place + LENGTH, n)
    return place, h, span_hash(cs, start, end) ^ mix((place - start).astype(np.uint64))


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = buffers(column)
    for i, j in slices(offsets, 1):
        for k in range(i, j):
            yield k, raw[offsets[k] : offsets[k + 1]]


def _grams(rows: DataFrame) -> DataFrame:
    """Hashes of all anchors' grams alone: what is counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            size = 0
            for _, data in _texts(batch.column(0)):
                if len(data) < LENGTH:
                    continue
                out.append(_places(prefix_hash(data))[1].view(np.int64))
                size += len(out[-1])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["h"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["h"])

    return rows.select("_text").mapInArrow(run, "h long")


def _occurrences(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[tuple[np.ndarray, ...]] = []
            size = 0

            def flush() -> pa.RecordBatch:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "fp", "_id", "_k", "pos"])

            for k, data in _texts(batch.column(2)):
                if len(data) < LENGTH:
                    continue
                place, h, fp = anchors(data)
                m = len(place)
                out.append((h.view(np.int64), fp.view(np.int64), np.full(m, ids[k]), np.full(m, keys[k]), place.astype(np.int32)))
                size += m
                if size > 200_000:
                    yield flush()
                    out, size = [], 0
            if out:
                yield flush()

    return rows.select("_id", "_k", "_text").mapInArrow(run, "h long, fp long, _id long, _k long, pos int")


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans; touching spans join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


_SNIPPET = "h long, _id long, _k long, start int, known boolean, bytes binary, w long, pos int"


def _snippets(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Texts of the asked anchors: snippets, or for crowded anchors the digests of all their windows."""
    joined = rows.join(asked, ["_id", "_k"]).select("_id", "_k", "_text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("h", pa.int64()), ("_id", pa.int64()), ("_k", pa.int64()), ("start", pa.int32()), ("known", pa.bool_()), ("bytes", pa.binary()), ("w", pa.int64()), ("pos", pa.int32())]
        )
        for batch in batches:
            asks = batch.column(3).to_pylist()
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for k, data in _texts(batch.column(2)):
                raw = data.tobytes()
                cs = None
                for a in asks[k]:
                    pos, start = a["pos"], max(a["pos"] - REACH, 0)
                    end = min(pos + LENGTH, len(raw))
                    if not a["crowded"]:
                        out.append((a["h"], ids[k], keys[k], start, a["known"], raw[start:end], None, pos))
                        continue
                    cs = prefix_hash(data) if cs is None else cs
                    p = np.arange(start, end - LENGTH + 1)
                    for w, q in zip(span_hash(cs, p, p + LENGTH).view(np.int64).tolist(), p.tolist(), strict=True):
                        out.append((a["h"], ids[k], keys[k], start, a["known"], None, w, q))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return joined.mapInArrow(run, _SNIPPET)


def _sharing(rows: list[dict]) -> list[dict]:
    """Snippets that agree with another of their anchor in the SIDE bytes before or after the gram; no others share a window."""
    seen: dict[tuple, int] = {}
    sides = []
    for r in rows:
        at, b = r["pos"] - r["start"], r["bytes"]
        left = (r["h"], 0, b[at - SIDE : at]) if at >= SIDE else None
        right = (r["h"], 1, b[at + GRAM : at + GRAM + SIDE]) if len(b) >= at + GRAM + SIDE else None
        sides.append((left, right))
        for x in (left, right):
            if x is not None:
                seen[x] = seen.get(x, 0) + 1
    return [r for r, (left, right) in zip(rows, sides, strict=True) if seen.get(left, 0) > 1 or seen.get(right, 0) > 1]


def _decided(snippets: DataFrame) -> DataFrame:
    """Spans of the snippets' windows that occur elsewhere, found by merging shard transforms.

    Rows arrive sorted by anchor; whole groups are taken up to about CHUNK_BYTES at a time.
    """

    def chunk_spans(rows: list[dict]) -> pa.RecordBatch:
        names = ["_id", "_k", "start", "end"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        rows = _sharing(rows)
        if not rows:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)
        shards, offsets, at, begin = [], [], 0, 0
        lengths = np.array([len(r["bytes"]) for r in rows])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), dtype=np.uint8)
        while begin < len(rows):
            stop = max(int(np.searchsorted(ends, at + SHARD_BYTES, side="right")), begin + 1)
            stop = min(stop, len(rows))
            upto = int(ends[stop - 1])
            shards.append(bwt_merge.shard(data[at:upto], ends[begin:stop] - at, BLOCK, LENGTH // BLOCK))
            offsets.append(at)
            at, begin = upto, stop
        which = np.repeat(np.arange(len(rows)), lengths)
        inside = np.arange(len(data)) - (ends - lengths)[which]
        absolute = inside + np.array([r["start"] for r in rows])[which]
        keys = np.array([hash((r["_id"], r["_k"])) for r in rows], dtype=np.int64).view(np.uint64)
        physical = mix(keys[which] + absolute.astype(np.uint64))
        known = np.array([r["known"] for r in rows])
        found = bwt_merge.repeated(
            shards, np.array(offsets), LENGTH // BLOCK, physical, inside + LENGTH <= lengths[which], known[which]
        )
        found = np.sort(found[~known[which[found]]])
        out: list[tuple] = []
        if len(found):
            owner = which[found]
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(found) > LENGTH) | (np.diff(owner) != 0)]))
            stops = np.append(cut[1:], len(found)) - 1
            for i, j in zip(cut, stops, strict=True):
                r = rows[owner[i]]
                # runs of window starts no further apart than a window cover everything between
                out.append((r["_id"], r["_k"], int(absolute[found[i]]), int(absolute[found[j]]) + LENGTH))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if size > CHUNK_BYTES and r["h"] != held[-1]["h"]:
                    yield chunk_spans(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield chunk_spans(held)

    source = snippets.where("bytes IS NOT NULL").select("h", "_id", "_k", "start", "known", "bytes", "pos")
    source = source.repartition("h").sortWithinPartitions("h")
    return source.mapInArrow(run, "_id long, _k long, start int, end int")


def _kept(rows: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Digest of what is left of each text, from its spans (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, runs, digests = [], [], [], []
            spans = batch.column(2).to_pylist()
            for k, data in _texts(batch.column(1)):
                s = spans[k] or []
                start = np.array([x["start"] for x in s], dtype=np.int64)
                end = np.array([x["end"] for x in s], dtype=np.int64)
                start, end = _merged(start, end)
                raw, at = data.tobytes(), 0
                digest = hashlib.sha256()
                for i, j in zip(start.tolist(), end.tolist(), strict=True):
                    digest.update(raw[at:i])
                    at = j
                digest.update(raw[at:])
                size.append(len(raw))
                removed.append(int((end - start).sum()))
                runs.append(len(start))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), batch.column(2)],
                ["_real", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    schema = f"_real {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    out = rows.select("_real", "_text", "spans").mapInArrow(run, schema)
    return out.withColumnRenamed("_real", id_col)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans for every row of ``docs``.

    Every byte covered by a LENGTH-byte string that also starts elsewhere in the corpus, the same
    text included, is removed; spans are judged on the input.

    1. Texts emit anchors; anchors that occur once are dropped by counting.
    2. Anchors whose whole snippets (all windows that hold the anchor) occur twice are settled.
    3. The other snippets, with one of each settled kind, are gathered by anchor. Tasks build the
       transforms of shards of snippets and merge them; windows in intervals with several real places
       are repeats. An anchor with more than ``group`` different snippets sends digests of its
       windows instead, which are counted in the same way for any number of them.

    Null text counts as empty. Texts shorter than LENGTH have no spans. Rows that repeat a whole row
    are each other's repeats. Null ids are allowed. An empty table gives no rows; other columns are
    ignored.
    """
    private_names(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    whole_number = isinstance(docs.schema[id_col].dataType, IntegralType)
    number = F.col(id_col).cast("long") if whole_number else F.xxhash64(id_col)  # with _k it tells rows apart
    rows = docs.select(
        F.col(id_col).alias("_real"),
        F.coalesce(number, F.lit(-1)).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).withColumn("_k", F.xxhash64("_real", "_text"))
    occ = _occurrences(rows)
    often = _grams(rows).groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    occ = stored(occ.join(often, "h"))
    same = occ.groupBy("h", "fp").agg(F.count(F.lit(1)).alias("_c"), F.min("_k").alias("_rep"))
    same = checkpointed(same)
    kinds = same.groupBy("h").agg(F.count(F.lit(1)).alias("_kinds"))
    # Occurrences meet both counts by (h, fp): a frequent anchor is dealt out by its kinds.
    same = checkpointed(same.join(kinds, "h"))
    occ = occ.join(same, ["h", "fp"])
    occ = stored(
        occ.select(
            "_id", "_k", "pos", "h",
            (F.col("_c") > 1).alias("known"),
            ((F.col("_kinds") > 1) & ((F.col("_c") == 1) | (F.col("_k") == F.col("_rep")))).alias("ask"),
            (F.col("_kinds") > group).alias("crowded"),
        )
    )
    asked = (
        occ.where("ask")
        .groupBy("_id", "_k")
        .agg(F.collect_set(F.struct("pos", "h", "known", "crowded")).alias("asked"))
    )
    asked = checkpointed(asked)
    keys = asked.select("_id", "_k")
    few = keys.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(keys) if few else keys, ["_id", "_k"], "left_semi")
    parts = stored(_snippets(texts, asked))
    decided = _decided(parts)
    windows = parts.where("w IS NOT NULL")
    place = F.xxhash64("_id", "_k", "pos")
    again = windows.groupBy("h", "w").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"), F.max("known").alias("_any"))
    again = again.where("_lo != _hi OR _any").select("h", "w")
    crowded = windows.where("NOT known").join(again, ["h", "w"])
    settled = occ.where("known")
    spans = (
        settled.select("_id", "_k", F.greatest(F.col("pos") - REACH, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("end"))
        .unionByName(decided)
        .unionByName(crowded.select("_id", "_k", F.col("pos").alias("start"), (F.col("pos") + LENGTH).alias("end")))
    )
    spans = checkpointed(spans.groupBy("_id", "_k").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    touched = spans.select("_id", "_k")
    few = touched.count() <= BROADCAST_IDS
    touched = F.broadcast(touched) if few else touched
    # A settled snippet may end with its text.
    clipped = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], F.octet_length("_text")).alias("end"))
    )
    cut = rows.join(touched, ["_id", "_k"], "left_semi").join(spans, ["_id", "_k"]).withColumn("spans", clipped)
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    whole = rows.join(touched, ["_id", "_k"], "left_anti").withColumn("spans", none)
    return _kept(cut.select("_real", "_text", "spans").unionByName(whole.select("_real", "_text", "spans")), id_col, kind)
