"""Line deduplication by an exact set-similarity join over line tokens.

Texts are split, hashed and sorted in numpy; grouping, joining and verifying are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rarity
from .runtime import checkpointed, deleted, free_name, private_names, shuffles_freed, stored, stored_at
from .textbytes import buffers, mix, prefix_hash, slices, span_hash, words

PERCENT = 80
#: A posting meets this many before it in its list in one pass; longer lists are joined for the rest.
NEIGHBOURS = 128
#: Pairs that stand so near to each other in a list are verified first, and others only for sets still without a match.
NEAR = 24
#: Lines holding one word in their prefix are dealt to one task up to about this many, then salted.
LIST_SIZE = 20_000
#: Rows of ids or lists that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Up to so many words a set's bitmap is of all its words; a larger one's, which would tell nothing, of its prefix.
WHOLE = 200

_SPACE = r"[\x20\x09-\x0D]+"
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A slice of texts at a time: first text, hashes of words, and their lines; and the lines' texts and numbers."""
    raw, offsets = buffers(column)
    for i, j in slices(offsets):
        part = offsets[i : j + 1] - offsets[i]
        data = raw[offsets[i] : offsets[j]]
        starts, ends, _ = words(data, part)
        breaks = np.flatnonzero(data == 10)
        # The last line of a text may be empty and begin where the next text does: it comes before that.
        text = np.concatenate([np.arange(j - i), np.searchsorted(part, breaks, side="right") - 1])
        order = np.lexsort((text, np.concatenate([part[:-1], breaks + 1])))
        begin, text = np.concatenate([part[:-1], breaks + 1])[order], text[order]
        first = np.searchsorted(text, np.arange(j - i))
        h = span_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
        yield i, h, np.searchsorted(begin, starts, side="right") - 1, text, np.arange(len(text)) - first[text]


def _counts(docs: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for _, h, _, _, _ in _word_hashes(batch.column(0)):
                np.add.at(counts, rarity.counter(h, bits), 1)
        if counts.any():
            numbers, blobs = rarity.chunks(counts)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "counts"])

    return docs.select("_text").mapInArrow(run, "chunk int, counts binary")


def _described(docs: DataFrame, sketch, percent: int) -> DataFrame:
    """(_id, ln, _k, s, s2, size, bits, more, prefix, salts) of every line with a word.

    s and s2 are digests of its set. prefix holds 32 bits of its rarest words, as many as prefix filtering needs,
    without those that the whole corpus has once, which come first and are in no other line. bits is their bitmap. For
    sets of up to ``WHOLE``, bits and more have a bit where an odd number of its words fall. salts are there for words
    with long lists.
    """
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = sketch.value
        for batch in batches:
            for i, h, line, text, number in _word_hashes(batch.column(1)):
                if not len(h):
                    continue
                level = counted.common(h)
                order = np.argsort(h)
                order = order[np.argsort(level[order], kind="stable")]
                order = order[np.argsort(line[order].astype(np.uint16) if len(text) < 65536 else line[order], kind="stable")]
                h, line, level = h[order], line[order], level[order]
                fresh = np.ones(len(h), dtype=bool)
                fresh[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
                h, line, level = h[fresh], line[fresh], level[fresh]
                at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                size = np.diff(np.append(at, len(h)))
                s = mix(np.add.reduceat(mix(h), at) + size.astype(np.uint64))
                s2 = np.add.reduceat(mix(h ^ _SECOND), at)
                length = size - -(-percent * size // 100) + 1
                ends = np.cumsum(length)
                spot = np.repeat(at - ends + length, length) + np.arange(ends[-1])
                word, lev = h[spot], level[spot]
                again = lev > 0
                bits = np.bitwise_or.reduceat(np.where(again, np.uint64(1) << (word & np.uint64(63)), np.uint64(0)), ends - length)
                spot, upper = np.uint64(1) << (h & np.uint64(63)), (h & np.uint64(64)) > 0
                bits = np.where(size <= WHOLE, np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), spot), at), bits)
                more = np.where(size <= WHOLE, np.bitwise_xor.reduceat(np.where(upper, spot, np.uint64(0)), at), np.uint64(0))
                salt = np.ceil(counted.word_lists(lev) / LIST_SIZE).astype(np.int32)
                several = np.maximum.reduceat(salt, ends - length) > 1
                length = np.add.reduceat(again.astype(np.int64), ends - length)
                ends, salt = np.cumsum(length), salt[again]
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                prefix = pa.ListArray.from_arrays(offsets, pa.array((word[again] & _LOW).astype(np.uint32).view(np.int32)))
                salts = pa.array([salt[e - n : e].tolist() if x else None for e, n, x in zip(ends, length, several, strict=True)], pa.list_(pa.int32()))
                row = line[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i + text[row])), pa.array(number[row].astype(np.int32)), batch.column(2).take(pa.array(i + text[row])), pa.array(s.view(np.int64)), pa.array(s2.view(np.int64)),
                     pa.array(size.astype(np.int32)), pa.array(bits.view(np.int64)), pa.array(more.view(np.int64)), prefix, salts],
                    ["_id", "ln", "_k", "s", "s2", "size", "bits", "more", "prefix", "salts"],
                )

    return docs.select("_id", "_text", "_k").mapInArrow(run, f"_id {kind}, ln int, _k long, s long, s2 long, size int, bits long, more long, prefix array<int>, salts array<int>")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(salt, salts, size, ln, at, s, bits, more, _id, t) for the words of prefixes.

    at is a word's place in its set, times 2 ** 32, plus its rank among those that other lines may hold.
    """
    # Not the plain explode: it would add a filter on the array that makes it once more.
    p = sets.select("s", "_id", "ln", "bits", "more", "size", "salts", F.size("prefix").alias("of"), F.posexplode_outer("prefix").alias("rank", "t")).where("t IS NOT NULL")
    salts = F.coalesce(F.get("salts", F.col("rank")), F.lit(1))
    size = F.col("size").cast("long")
    p = p.withColumn("salts", salts).withColumn("pos", size - F.ceil(percent * size / 100) + 1 - F.col("of") + F.col("rank"))
    salt = F.when(F.col("salts") > 1, F.pmod("s", F.col("salts")) + 1).otherwise(F.lit(0)).cast("int")
    # Columns of small numbers stand together, and so do those of hashes: that packs better.
    return p.select(salt.alias("salt"), "salts", "size", "ln", (F.shiftleft("pos", 32) + F.col("rank")).alias("at"), "s", "bits", "more", "_id", "t")


def wanted_overlap(sa: np.ndarray, sb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that sets of two sizes must share, and how many of them in their prefixes.

    Beyond the prefix that ends first nothing is shared but what the other set still has.
    """
    need = (percent * (sa + sb) + 99 + percent) // (100 + percent)
    return need, need - np.maximum(-(-percent * sa // 100), -(-percent * sb // 100)) + 1


def may_match(a: dict[str, np.ndarray], b: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Length, positional and bitmap filters for sets that meet in the list of a word.

    Before the word they share at most the shorter part, after it too, of their prefixes as of all their words.
    Every bit in which the bitmaps of two prefixes differ is a word not shared. Similar sets pass in
    every list in which they meet, so what fails need not be counted.
    """
    sa, sb = a["size"], b["size"]
    ok = 100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb)
    at = np.flatnonzero(ok)
    if len(at):
        a, b = {c: v[at] for c, v in a.items()}, {c: v[at] for c, v in b.items()}
        need, early = wanted_overlap(a["size"], b["size"], percent)
        upto = 1 + np.minimum(a["rank"], b["rank"])
        most = upto + np.minimum(a["size"] - a["pos"], b["size"] - b["pos"]) - 1 >= need
        # Words of the prefixes after this one.
        ra, rb = (x["size"] - -(-percent * x["size"] // 100) - x["pos"] for x in (a, b))
        most &= upto + np.minimum(ra, rb) >= early
        # Of a negative number the bits of its absolute value would be counted.
        apart = np.bitwise_count((a["bits"] ^ b["bits"]).view(np.uint64)).astype(np.int64)
        ok[at] = most & (a["rank"] + ra + b["rank"] + rb + 2 - apart >= 2 * early)
    return ok


def bits_apart(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count((a[c] ^ b[c]).view(np.uint64)).astype(np.int64) for c in ("bits", "more") if c in a)


def alike(a: dict[str, np.ndarray], b: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """``may_match`` with the bitmap that both sets have.

    Where two bitmaps of all words differ is a word that one set has and the other has not, and similar sets have
    few of these.
    """
    large = (a["size"] > WHOLE) & (b["size"] > WHOLE)
    ok = may_match(a | {"bits": np.where(large, a["bits"], 0)}, b | {"bits": np.where(large, b["bits"], 0)}, percent)
    whole = (a["size"] <= WHOLE) & (b["size"] <= WHOLE)
    apart = bits_apart(a, b)
    return ok & (~whole | (apart <= a["size"] + b["size"] - 2 * wanted_overlap(a["size"], b["size"], percent)[0]))


def _met(posts: DataFrame, percent: int, neighbours: int) -> DataFrame:
    """Pairs (a, b, n, early, near) of sets that meet in n lists and may match; and (t) of lists longer than what meets.

    A posting meets those shortly before it and the first of its list, for the first of a group of
    edited lines is often what they were edited from. In the list of its first shared word a pair passes
    the positional filter, and it meets in as many lists as its prefixes share words, unless it is too
    far apart in some, which are long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "salt", "s", "size", "pos", "rank", "bits", "more"]
        held = {c: np.zeros(0, dtype=np.int64) for c in names}
        head: dict[str, int] | None = None  # the first of the list that the last batch ended in
        for batch in batches:
            new = {c: batch.column(c).to_numpy().astype(np.int64) for c in batch.schema.names}
            at = new.pop("at")
            new["pos"], new["rank"] = at >> 32, at & 0xFFFFFFFF
            old = len(held["t"])
            x = {c: np.concatenate([held[c], new[c]]) for c in names}
            n = len(x["t"])
            out: list[tuple[np.ndarray, ...]] = []

            def keep(a: dict[str, np.ndarray], b: dict[str, np.ndarray], near: np.ndarray, out=out) -> None:
                ok = alike(a, b, percent)
                a, b = {c: v[ok] for c, v in a.items()}, {c: v[ok] for c, v in b.items()}
                need, early = wanted_overlap(a["size"], b["size"], percent)
                left = 1 + np.minimum(a["size"] - a["pos"] - 1, b["size"] - b["pos"] - 1)
                out.append((a["s"], b["s"], early, left >= need, near[ok]))

            # Members of a row's list that stand before it; rows with most of them come first.
            opens = np.ones(n, dtype=bool)
            opens[1:] = (x["t"][1:] != x["t"][:-1]) | (x["salt"][1:] != x["salt"][:-1])
            before = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
            deep = old + np.argsort(-before[old:], kind="stable")
            fewer = -before[deep]
            at_lag: list[np.ndarray] = []
            for lag in range(1, neighbours + 1):
                here = deep[: np.searchsorted(fewer, -lag, side="right")]
                if not len(here):
                    break
                # Most pairs go by size and bitmaps, before more of them is looked at.
                sa, sb = x["size"][here - lag], x["size"][here]
                apart = bits_apart(*({c: x[c][at] for c in ("bits", "more")} for at in (here - lag, here)))
                ok = (100 * np.minimum(sa, sb) >= percent * np.maximum(sa, sb)) & ((np.maximum(sa, sb) > WHOLE) | ((100 + percent) * apart <= (100 - percent) * (sa + sb)))
                at_lag.append(np.stack([here[ok] - lag, here[ok]]))
            if at_lag:
                left, right = np.concatenate(at_lag, axis=1)
                keep({c: x[c][left] for c in names}, {c: x[c][right] for c in names}, right - left <= NEAR)
            far = np.sort(deep[: np.searchsorted(fewer, -neighbours - 1, side="right")])
            begins = np.ones(len(new["t"]), dtype=bool)
            begins[1:] = (new["t"][1:] != new["t"][:-1]) | (new["salt"][1:] != new["salt"][:-1])
            begins[0] = head is None or (head["t"], head["salt"]) != (new["t"][0], new["salt"][0])
            first = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), -1))
            own = first[far - old]
            heads = {c: np.where(own < 0, head[c] if head else 0, new[c][own]) for c in names}
            keep(heads, {c: x[c][far] for c in names}, np.ones(len(far), dtype=bool))
            more = np.unique(np.concatenate([x["t"][far], new["t"][new["salt"] > 0]]))
            found = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([c, pa.nulls(len(more), c.type)]) for c in found] + [pa.concat_arrays([pa.nulls(len(found[0]), pa.int32()), pa.array(more.astype(np.int32))])],
                ["a", "b", "early", "left", "near", "t"],
            )
            if first[-1] >= 0:
                head = {c: int(new[c][first[-1]]) for c in names}
            held = {c: x[c][max(0, n - neighbours - 1) :] for c in names}

    lists = posts.repartition("t", "salt").sortWithinPartitions("t", "salt", "_id", "ln", "s").select("t", "salt", "s", "size", "at", "bits", "more")
    rows = lists.mapInArrow(run, "a long, b long, early long, left boolean, near boolean, t int")
    met = rows.groupBy("a", "b", "t").agg(F.count(F.lit(1)).alias("n"), F.max("early").alias("early"), F.max("left").alias("left"), F.max("near").alias("near"))
    return met.where("t IS NOT NULL OR left")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets, those whose words reach the similarity, as the digests of the later set.

    Only the lines in question are read again, each at its set's first place; each pair is compared once.
    """
    ids = checkpointed(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct())
    few = ids.count() <= BROADCAST_ROWS
    places = sets.join(F.broadcast(ids) if few else ids, "s").select("s", "s2", "_id", "ln", "_k")
    wanted = places.groupBy(F.col("_id").alias("_wid"), F.col("_k").alias("_wk")).agg(F.collect_list(F.struct("ln", "s", "s2")).alias("_want"))
    wanted = checkpointed(wanted)
    found = docs.join(F.broadcast(wanted) if few else wanted, F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_k") == F.col("_wk")))
    cut = found.select("_id", "_want", F.split(F.coalesce("_text", F.lit("")), "\n").alias("_l"))
    cut = cut.select("_id", F.explode_outer(F.transform("_want", lambda w: F.struct(w["s"].alias("s"), w["s2"].alias("s2"), w["ln"].alias("ln"), F.get("_l", w["ln"]).alias("line")))).alias("w"))
    line = F.array_distinct(F.transform(F.array_remove(F.split(F.col("w.line"), _SPACE), ""), lambda w: F.xxhash64(w)))
    cut = cut.select("w.s", "w.s2", F.struct("_id", "w.ln").alias("place"), line.alias("words"))
    cut, path = stored_at(cut)
    side = lambda k: cut.select(F.col("s").alias(k), F.struct("place", "s", "s2").alias(f"f{k}"), F.col("words").alias(f"w{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("fa.place") != F.col("fb.place"))
    both = both.select("fa", "fb", F.size("wa").alias("na"), F.size("wb").alias("nb"), F.size(F.array_intersect("wa", "wb")).alias("o"))
    both = both.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o")))
    later = F.when(F.col("fa")["place"] > F.col("fb")["place"], F.col("fa")).otherwise(F.col("fb"))
    found = checkpointed(both.select(later.alias("l")).select("l.s", "l.s2").distinct())
    deleted(docs.sparkSession, path)
    return found


def _rest(posts: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """Pairs of the sets without an earlier match and all sets of their long lists that may match.

    A set that still looks for a match goes to every salt of its list.
    """
    pos, size = F.shiftright("at", 32).cast("int"), F.col("size")
    left = (size - F.ceil(percent * size / 100) - pos).cast("int")  # words of the prefix after this one
    member = F.struct("s", "bits", "more", "size", pos.alias("pos"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("rank"), left.alias("left"), F.struct("_id", "ln").alias("place"))
    x = posts.select("t", "salt", member.alias("x"))
    done = gone.select("s").distinct()
    done = F.broadcast(done) if done.count() <= BROADCAST_ROWS else done
    y = posts.join(done, "s", "left_anti").select("t", "salts", member.alias("y"))
    everywhere = F.when(F.col("salts") > 1, F.sequence(F.lit(1), F.col("salts"))).otherwise(F.array(F.lit(0)))
    y = y.select("t", "y", F.explode(everywhere).alias("salt"))
    pairs = y.join(x, ["t", "salt"]).where(_alike(percent, "x", "y") & (F.col("x.place") < F.col("y.place")))
    return checkpointed(pairs.select(F.col("x.s").alias("a"), F.col("y.s").alias("b")).distinct())


def _alike(percent: int, a: str, b: str) -> Column:
    """``alike`` and the positional filter of a first shared word for two structs of a row, as a condition.

    Written without divisions and with the filter that most pairs fail first, for it is asked of every pair of a list.
    """
    field = lambda name: (F.col(f"{a}.{name}"), F.col(f"{b}.{name}"))
    (sa, sb), (pos_a, pos_b), (rank_a, rank_b), (ra, rb) = field("size"), field("pos"), field("rank"), field("left")
    sa, sb = sa.cast("long"), sb.cast("long")
    wanted = lambda shared: (100 + percent) * shared >= percent * (sa + sb)
    apart = sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("bits", "more"))
    after = F.greatest(sa - pos_a - ra, sb - pos_b - rb) - 1
    return (
        (100 * F.least(sa, sb) >= percent * F.greatest(sa, sb))
        & (((sa > WHOLE) | (sb > WHOLE)) | ((100 + percent) * apart <= (100 - percent) * (sa + sb)))
        & wanted(F.least(sa - pos_a, sb - pos_b))
        & wanted(1 + F.least(rank_a, rank_b) + F.least(ra, rb) + after)
        & (((sa <= WHOLE) | (sb <= WHOLE)) | wanted(F.shiftright(rank_a + ra + rank_b + rb + 2 - apart, 1) + after))
    )


def _dropped_sets(docs: DataFrame, percent: int, neighbours: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines with their sets; sets with their first places and numbers of lines; and sets like an earlier one."""
    spark, bits = docs.sparkSession, rarity.sketch_bits(docs)
    sketch = spark.sparkContext.broadcast(rarity.summed(_counts(docs, bits), bits))
    lines = stored(_described(docs, sketch, percent))
    place = F.min(F.struct("_id", "ln", "_k")).alias("first")
    rest = [F.first(c).alias(c) for c in ("size", "bits", "more", "prefix", "salts")]
    sets = lines.groupBy("s", "s2").agg(place, F.count(F.lit(1)).alias("n"), *rest)
    # From here on s is a set's number, which takes less room in postings and pairs than a digest.
    sets = sets.withColumnRenamed("s", "digest").withColumn("s", F.monotonically_increasing_id())
    sets = stored(sets.select("s", "digest", "s2", "first.*", "n", "size", "bits", "more", "prefix", "salts"))
    firsts = sets.select("s", "digest", "s2", "_id", "ln", "_k", "n")
    met, met_at = stored_at(_met(_postings(sets, percent), percent, neighbours))
    long = checkpointed(met.where("t IS NOT NULL").select("t").distinct())
    few = long.count() <= BROADCAST_ROWS
    posts, posts_at = stored_at(_postings(sets, percent).join(F.broadcast(long) if few else long, "t", "left_semi"))
    # Pairs that meet in too few lists cannot match, unless both are in long lists and may have met there.
    pairs, apart = met.where("t IS NULL").select("a", "b", "n", "early", "near"), posts.select("s").distinct()
    close = pairs.where("n >= early").select("a", "b", "near")
    maybe = pairs.where("n < early").select("a", "b", "near").join(apart.withColumnRenamed("s", "a"), "a", "left_semi")
    maybe = maybe.join(apart.withColumnRenamed("s", "b"), "b", "left_semi").select("a", "b", "near")
    close = checkpointed(close.unionByName(maybe))
    deleted(spark, met_at)
    gone = _verified(close.where("near").select("a", "b"), firsts, docs, percent)
    found = gone.select(F.col("s").alias("b")).distinct()
    others = checkpointed(close.where("NOT near").join(found, "b", "left_anti").select("a", "b"))
    if not others.isEmpty():
        gone = checkpointed(gone.unionByName(_verified(others, firsts, docs, percent)).distinct())
    more = None if long.isEmpty() else _rest(posts, gone, percent)
    deleted(spark, posts_at)
    if more is not None:
        gone = checkpointed(gone.unionByName(_verified(more, firsts, docs, percent)).distinct())
    return lines, firsts, gone


def removed_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """id, n_lines, n_removed, removed (line numbers from 0) for every id.

    Lines are compared by their sets of words; a line goes if any line before it, in order of
    (id, line number), has a set whose Jaccard similarity with its own is at least ``percent``.

    Lines with equal sets go on as one, by 128-bit digests. Each set posts its rarest words; within a
    word's list, in corpus order, a set is held against the ``neighbours`` before it and the first. Of longer (or
    salted) lists, the sets without an earlier match by then are joined with all others, salt by salt.
    So groups of alike lines are not paired among themselves, and no match is missed. What passes the
    filters is verified on 64-bit hashes of words.

    Lines without words stay. Null text is the empty text, with one line. Rows with a null id come
    before all others; rows that repeat an id are one text's lines at equal places, and lines with
    equal or alike sets at one place all stay. Other columns are ignored; an empty table gives no rows.
    """
    private_names(docs, id_col, text_col)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_k", F.xxhash64("_text"))
    with shuffles_freed(docs.sparkSession):
        lines, firsts, gone = _dropped_sets(docs, percent, neighbours)
    # A line goes with its set, or as a repeat of its set's first line.
    marks = firsts.join(gone.withColumn("_dup", F.lit(True)), ["s", "s2"], "left").where("_dup OR n > 1")
    marks = marks.select(F.col("digest").alias("s"), "s2", "_dup", F.col("_id").alias("_fid"), F.col("ln").alias("_fln"))
    places = lines.select("_id", "ln", "s", "s2").join(marks, ["s", "s2"])
    is_first = F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("ln") == F.col("_fln"))
    places = places.where(F.coalesce("_dup", F.lit(False)) | ~is_first)
    per_text = places.groupBy(F.col("_id").alias("_pid")).agg(F.array_sort(F.collect_set("ln")).alias("removed"))
    sizes = docs.groupBy("_id").agg(
        F.max(F.size(F.split(F.coalesce("_text", F.lit("")), "\n"))).cast("long").alias("n_lines")
    )
    out = sizes.join(per_text, F.col("_id").eqNullSafe(F.col("_pid")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(
        F.col("_id").alias(id_col), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed")
    )


def without_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later lines taken out of its texts; all columns and rows stay.

    Null texts and texts without such lines are unchanged; null and repeated ids are as in ``removed_lines``.
    """
    rid, gone = free_name(docs, "_rid"), free_name(docs, "_gone")
    found = removed_lines(docs, percent, id_col, text_col).select(F.col(id_col).alias(rid), F.col("removed").alias(gone))
    kept = F.array_join(
        F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n"
    )
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(rid)), "left")
    return joined.withColumn(text_col, kept).select(*docs.columns)
