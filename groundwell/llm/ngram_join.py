"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters, one check a pair."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rarity
from .components import joined
from .runtime import checkpointed, free_name, private_names, stored
from .textbytes import buffers, shingles, slices

#: Ids of texts to verify are broadcast up to this many, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Heads of lists that a set is compared with in a round, and rounds before the join.
HEADS = 2
ROUNDS = 2
#: Pairs across components that the join may have for each set before the best of them go first.
PAIRS_A_SET = 2
#: Texts holding one n-gram are dealt to one task up to about this many, then salted.
LIST_SIZE = 20_000


def _fingerprint(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


#: Words of a set's parity sketch: 1024 bits, 128 bytes a distinct set.
SKETCH_WORDS = 16


def parities(h: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of the set's ids falls on it: sets that differ in d ids differ in d bits at most."""
    at = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(batch_column: pa.Array, n: int, level: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, its set, with ``level`` the least of its n-grams' words) of an Arrow column, a slice of about a megabyte at a time."""
    raw, offsets = buffers(batch_column)
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        h, at, least = shingles(raw[part[0] : part[-1]], part - part[0], n, level)
        for k in range(j - i):
            yield i + k, h[at[k] : at[k + 1]], least[at[k] : at[k + 1]] if level else least


def _describe(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """One row per text: _id, n, fp, bits; and rows of sketch counters (chunk, counts) per task."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = np.zeros(1 << bits, dtype=np.uint32), np.zeros(1 << rarity.GRAM_BITS, dtype=np.uint32)
        seen: set[bytes] = set()
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            sizes, prints, bitmaps = [], [], []
            last = None
            for _, h, w in _sets(batch.column(1), n):
                if w is not last:  # all words of a slice, copies included
                    np.add.at(words, rarity.counter(w, bits), 1)
                    last = w
                sizes.append(len(h))
                prints.append(_fingerprint(h) if len(h) else None)
                bitmaps.append(parities(h) if len(h) else None)
                if len(h) and prints[-1] not in seen:
                    seen.add(prints[-1])
                    np.add.at(grams, rarity.counter(h, rarity.GRAM_BITS), 1)
            empty = len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bitmaps, pa.list_(pa.int64())), pa.nulls(empty, pa.int32()), pa.nulls(empty, pa.binary())],
                ["_id", "n", "fp", "bits", "chunk", "counts"],
            )
        if seen:
            numbers, blobs = rarity.chunks(words, grams)
            k = len(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())],
                ["_id", "n", "fp", "bits", "chunk", "counts"],
            )

    return docs.mapInArrow(run, f"_id {kind}, n long, fp binary, bits array<long>, chunk int, counts binary")


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Smallest overlap of sets of sizes a and b whose Jaccard similarity reaches percent."""
    total = percent * (a + b) + (99 + percent)
    return F.floor((total - F.pmod(total, F.lit(100 + percent))) / (100 + percent))


def _postings(docs: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """(sh, salt, salts, fp, size, pos): the rarest n-grams of each distinct set, as many as prefix filtering needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = sketch.value
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            prints: list[bytes] = []
            for _, h, common in _sets(batch.column(0), n, counted.common):
                size = len(h)
                if not size or (fp := _fingerprint(h)) in seen:
                    continue
                seen.add(fp)
                length = size - -(-percent * size // 100) + 1
                order = np.argsort(counted.order(h, common), kind="stable")[:length]  # ties by id: h is ascending
                # 0 for a list that one task takes whole, else one of the salts of a long list
                salts = np.ceil(np.minimum(counted.gram_lists(h[order]), counted.word_lists(common[order])) / LIST_SIZE).astype(np.int64)
                salt = np.where(salts > 1, int.from_bytes(fp[:4], "little") % salts + 1, 0)
                out.append((h[order].view(np.int64), salt.astype(np.int32), np.full(length, size, dtype=np.int32), salts.astype(np.int32)))
                prints.append(fp)
            if not out:
                continue
            lengths = [len(x[0]) for x in out]
            ends = np.cumsum(lengths)
            pos = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
            fps = pa.array(prints, pa.binary()).take(pa.array(np.repeat(np.arange(len(prints)), lengths)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[3] for x in out])), fps, pa.array(np.concatenate([x[2] for x in out])), pa.array(pos.astype(np.int32))],
                ["sh", "salt", "salts", "fp", "size", "pos"],
            )

    return docs.select("_text").mapInArrow(run, "sh long, salt int, salts int, fp binary, size int, pos int")


def _sizes() -> tuple[Column, Column]:
    return F.col("size_a").cast("long"), F.col("size_b").cast("long")


def _near_in_size(percent: int) -> Column:
    sa, sb = _sizes()
    return 100 * F.least(sa, sb) >= percent * F.greatest(sa, sb)


def _in_place(percent: int) -> Column:
    """Prefix and positional filters, for the first n-gram that the prefixes of two sets share."""
    sa, sb = _sizes()
    small = F.least(sa, sb)
    at = F.when(sa <= sb, F.col("pos_a")).otherwise(F.col("pos_b"))
    # Against sets at least as large, the smaller set needs the shorter prefix.
    short = small - _least_overlap(small, small, percent) + 1
    return (at < short) & (1 + F.least(sa - F.col("pos_a") - 1, sb - F.col("pos_b") - 1) >= _least_overlap(sa, sb, percent))


def _side_by_side(percent: int) -> Column:
    """Positional filter for any n-gram that two sets share: at most the shorter part before it and the shorter part after it are shared too.

    A pair that reaches the similarity passes with each n-gram, so what fails need not be counted.
    """
    sa, sb = _sizes()
    before, after = F.least("pos_a", "pos_b"), F.least(sa - F.col("pos_a") - 1, sb - F.col("pos_b") - 1)
    return before + 1 + after >= _least_overlap(sa, sb, percent)


def _folded(bits: Column, half: int) -> Column:
    """One word for half of a sketch: folding parities by xor gives a smaller sketch of the same kind."""
    size = SKETCH_WORDS // 2
    return F.aggregate(F.slice(bits, 1 + half * size, size), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _sketches_near(percent: int) -> Column:
    """Whether folded sketches differ in no more bits than similar sets can differ in ids."""
    sa, sb = _sizes()
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ("low", "high")), F.lit(0))
    return apart <= sa + sb - 2 * _least_overlap(sa, sb, percent)


def _shared_prefix(percent: int) -> Column:
    """How many n-grams the prefixes of two sets must share.

    Beyond the prefix that ends first nothing is shared but what the other set still has.
    """
    sa, sb = _sizes()
    upto = lambda s: F.floor((percent * s + 99) / 100)
    return _least_overlap(sa, sb, percent) - F.greatest(upto(sa), upto(sb)) + 1


def _enough_left(percent: int) -> Column:
    """Whether the lists that two sets are still in before and after a shared n-gram can hold what their prefixes must share."""
    before = F.least("rank_a", "rank_b")
    after = F.least(F.col("of_a") - F.col("rank_a"), F.col("of_b") - F.col("rank_b"))
    return before + after >= _shared_prefix(percent)


def _stars(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each set with the head of its lists, where their components differ.

    The head is the set with the most postings that others share: in a group of edited copies, the
    one that they are copies of. A set is paired with the few heads it meets most often; what this
    leaves open is settled by the join that follows.
    """
    by = Window.partitionBy("sh", "salt").orderBy(F.desc("weight"), "fp")
    head = F.first(F.struct("fp", "size", "pos", "root")).over(by)
    p = posts.withColumn("_h", head).where("_h.fp != fp AND _h.root != root")
    p = p.select(
        F.col("_h.fp").alias("a"), F.col("fp").alias("b"), F.col("_h.size").alias("size_a"), F.col("_h.pos").alias("pos_a"),
        F.col("size").alias("size_b"), F.col("pos").alias("pos_b"),
    )
    met = p.where(_near_in_size(percent) & _in_place(percent)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("_n"), "a"))
    met = met.withColumn("_nth", nth).where(F.col("_nth") <= HEADS)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def overlap_possible(a: np.ndarray, b: np.ndarray, need: int, depth: int = 3) -> bool:
    """Suffix filter: split both ascending sets at a pivot; parts on different sides share nothing."""

    def bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
        if depth == 0 or len(a) < 4 or len(b) < 4:
            return min(len(a), len(b))
        pivot = b[len(b) // 2]
        i, j = int(np.searchsorted(a, pivot)), len(b) // 2
        return bound(a[:i], b[:j], depth - 1) + bound(a[i:], b[j:], depth - 1)

    return bound(a, b, depth) >= need


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than similar sets can differ in ids."""
    side = lambda x: nodes.select(F.col("fp").alias(x), F.col("n").alias(f"_n_{x}"), F.col("bits").alias(f"_bits_{x}"))
    apart = F.aggregate(F.zip_with("_bits_a", "_bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = F.col("_n_a") + F.col("_n_b") - 2 * _least_overlap(F.col("_n_a"), F.col("_n_b"), percent)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= most).select(*pairs.columns)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of fingerprints whose texts' sets reach the similarity; each is compared once."""
    p = pairs.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(
        nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b"
    )
    p = checkpointed(p.select("a", "b", "ra", "rb"))
    ids = p.select(F.col("ra").alias("_id")).union(p.select("rb")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "_id", "left_semi")
    left = texts.select(F.col("_id").alias("ra"), F.col("_text").alias("ta"))
    right = texts.select(F.col("_id").alias("rb"), F.col("_text").alias("tb"))
    both = p.join(left, "ra").join(right, "rb").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for start in range(0, len(batch), 128):
                part = batch.slice(start, 128)
                fa, fb = part.column(0).to_pylist(), part.column(1).to_pylist()
                for (i, x, _), (_, y, _) in zip(_sets(part.column(2), n), _sets(part.column(3), n), strict=True):
                    # ids shared by different texts bring in texts that are not meant
                    ok = _fingerprint(x) == fa[i] and _fingerprint(y) == fb[i]
                    need = (percent * (len(x) + len(y)) + 99 + percent) // (100 + percent)
                    ok = ok and overlap_possible(x, y, need)
                    keep.append(ok and len(np.intersect1d(x, y, assume_unique=True)) >= need)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"]
            )

    return both.mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id for every row of ``docs``.

    A text's set holds its distinct n-word shingles after lower-casing A-Z. Two texts link when
    100 * intersection >= percent * union; component_id is the smallest id that links reach.

    1. Texts with equal sets share a fingerprint and go on as one.
    2. Each set emits its rarest shingles, a shingle being as rare as its rarest word; sets are compared with the heads of their shingles' lists
       and links are contracted, in a fixed number of rounds of a few pairs a set.
    3. Lists that still hold several components are joined on the shingle, across components only,
       under the same filters; pairs whose prefixes share too little, or whose parity sketches differ too much, go before texts are read. So no link between different texts is lost, while the members of one
       group are not paired with each other.

    Null text counts as empty: no shingles, linked with nothing, its own component. Texts of fewer
    than n words are one shingle. Rows with a null id are returned with a null component and link
    nothing. Equal rows are linked. Shingles are 64-bit hashes; an empty table gives no rows; other
    columns are ignored.
    """
    private_names(docs, id_col, text_col)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    bits = rarity.sketch_bits(docs)
    described = checkpointed(_describe(docs, n, bits))
    info = described.where("chunk IS NULL").select("_id", "n", "fp")
    sets = described.where("chunk IS NULL AND fp IS NOT NULL AND _id IS NOT NULL").groupBy("fp")
    nodes = checkpointed(sets.agg(F.min("_id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits")))
    sketch = spark.sparkContext.broadcast(rarity.summed(described.where("chunk IS NOT NULL"), bits))
    posts = _postings(docs.where("_id IS NOT NULL"), n, percent, sketch).repartition("sh", "salt")
    by = Window.partitionBy("sh", "salt").orderBy("size", "fp")
    fresh = posts.withColumn("_last", F.lag("fp").over(by)).where("_last IS NULL OR _last != fp").drop("_last")
    neighbours = F.lag("fp").over(by).isNotNull() | F.lead("fp").over(by).isNotNull()
    # A salted list has members in other tasks too.
    live = stored(fresh.withColumn("_shared", neighbours | (F.col("salt") > 0)).where("_shared").drop("_shared"))
    weights = live.groupBy("fp").agg(F.count(F.lit(1)).alias("weight"))
    live = live.join(weights, "fp")
    post, roots, tested = live.withColumn("root", F.col("fp")), None, None

    def verified(pairs: DataFrame) -> bool:
        """Takes the pairs not yet tested; true if they bring new links."""
        nonlocal tested, roots
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = checkpointed(pairs)
        if pairs.isEmpty():
            return False
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = checkpointed(_verified(pairs, docs, nodes, n, percent))
        if found.isEmpty():
            return False
        roots = joined(roots, found)
        return True

    def mixed() -> DataFrame:
        """Postings of the lists that hold several components."""
        if roots is None:
            return post
        p = live.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = p.groupBy("sh").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo != _hi")
        return stored(p.join(several.select("sh"), "sh", "left_semi"))

    for _ in range(ROUNDS):
        if not verified(_plausible(_stars(post, percent), nodes, percent)):
            break
        post = mixed()
    def across(post: DataFrame) -> DataFrame:
        """(a, b, _n): pairs of different components that may match, and how many lists hold both."""
        # One side of a salted list goes to all of its salts, so that no task has the whole list.
        everywhere = F.when(F.col("salts") > 1, F.sequence(F.lit(1), F.col("salts"))).otherwise(F.array(F.lit(0)))
        own = ("fp", "size", "pos", "root", "low", "high", "rank", "of")
        # Only the lists that are left to join carry sketches.
        post = post.join(nodes.select("fp", _folded(F.col("bits"), 0).alias("low"), _folded(F.col("bits"), 1).alias("high")), "fp")
        by = Window.partitionBy("fp")
        post = post.withColumn("rank", F.row_number().over(by.orderBy("pos"))).withColumn("of", F.count(F.lit(1)).over(by) + 1)
        x = post.select("sh", F.explode(everywhere).alias("salt"), *[F.col(c).alias(f"{c}_a") for c in own])
        y = post.select("sh", "salt", *[F.col(c).alias(f"{c}_b") for c in own])
        p = x.join(y, ["sh", "salt"]).where("root_a != root_b AND fp_a < fp_b").where(_near_in_size(percent) & _side_by_side(percent) & _enough_left(percent) & _sketches_near(percent))
        # All lists that hold both sets of such a pair are here, so they tell how much its prefixes share.
        p = p.groupBy(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).agg(
            F.count(F.lit(1)).alias("_n"), F.max(_in_place(percent)).alias("_in"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b")
        )
        p = p.where(F.col("_in") & (F.col("_n") >= _shared_prefix(percent))).select("a", "b", "_n")
        p = _plausible(p, nodes, percent)
        return checkpointed(p if tested is None else p.join(tested, ["a", "b"], "left_anti"))

    pairs, some = across(post), PAIRS_A_SET * nodes.count()
    for _ in range(ROUNDS):
        if pairs.count() <= some:
            break
        # Too many for one go: first those that share most, for what they link need not be compared further.
        nth = lambda c, d: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("_n"), d))
        best = pairs.withColumn("_a", nth("a", "b")).withColumn("_b", nth("b", "a")).where(F.least("_a", "_b") <= HEADS)
        if not verified(best.select("a", "b")):
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
            break
        pairs = across(mixed())
    verified(pairs.select("a", "b"))
    if roots is None:
        roots = nodes.limit(0).select(F.col("fp").alias("node"), F.col("fp").alias("root"))
    label = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = label.groupBy("root").agg(F.min("rep").alias("_component"))
    label = label.join(smallest, "root").select("fp", "_component")
    out = info.join(label, "fp", "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; all columns unchanged.

    Rows with a null id stay. Of several rows with that id all stay: equal rows are the business of
    exact deduplication.
    """
    found = near_duplicates(docs, n, percent, id_col, text_col)
    name = free_name(docs, "_gone")
    gone = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(name)).distinct()
    gone = checkpointed(gone)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
