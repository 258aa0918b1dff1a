"""Mixing sources to target weights by Pfair scheduling of source blocks (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import checkpointed, private_names

#: Rows of a block.
BLOCK_ROWS = 32
#: Slots of one period of the schedule, about: weights are rounded to multiples of one slot.
PERIOD = 1000
#: Slots of a plan that is broadcast.
BROADCAST_SLOTS = 100_000


def _source(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def ranked(docs: DataFrame, id_col: str, source_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pseudo-random rank of every row within its source, from 0, without one task per source.

    Rows are ordered by the digest of their id. The first three hex digits of the digest cut a source
    into 4096 parts; ranks within a part are shifted by the sizes of the parts before it.
    """
    rows = docs.select(F.col(id_col).alias("_id"), _source(F.col(source_col)).alias("_source"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    rows = rows.withColumn("_key", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_part", F.substring("_key", 1, 3))
    parts = rows.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_source", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_key", "_id")) - 1
    return rows.withColumn("_nth", nth).join(parts, ["_source", "_part"]).withColumn("_rank", F.col("_before") + F.col("_nth"))


def slots(weights: DataFrame) -> DataFrame:
    """The period of the schedule: (_source, _w, _turn, _slot, _period), one row per slot.

    ``weights`` holds (_source, _w) with whole positive weights that sum to the period. Block k of a
    source (from 1) is released at slot floor((k - 1) * period / w) and due by slot
    ceil(k * period / w); each slot takes the released block with the earliest deadline, ties in
    order of source. On one resource of full use this meets every deadline, so that no source is
    ever a whole block ahead of or behind its share. One row folds over the slots: the table of
    weights has a row per source, and the period does not grow with the corpus.
    """
    table = weights.agg(
        F.sort_array(F.collect_list(F.struct("_source", "_w"))).alias("_s"), F.sum("_w").cast("long").alias("_period")
    )
    state = F.struct(
        F.transform("_s", lambda s: F.lit(1).cast("long")).alias("next"), F.array().cast("array<int>").alias("taken")
    )

    def take(acc: Column, t: Column) -> Column:
        options = F.filter(
            F.transform(
                "_s",
                lambda s, i: F.struct(
                    F.ceil(F.get(acc["next"], i) * F.col("_period") / s["_w"]).alias("due"),
                    F.floor((F.get(acc["next"], i) - 1) * F.col("_period") / s["_w"]).alias("release"),
                    i.alias("i"),
                ),
            ),
            lambda o: o["release"] <= t,
        )
        pick = F.array_min(F.transform(options, lambda o: F.struct(o["due"], o["i"])))["i"]
        moved = F.transform(F.array(pick), lambda p: F.struct(
            F.transform(acc["next"], lambda k, i: F.when(i == p, k + 1).otherwise(k)).alias("next"),
            F.concat(acc["taken"], F.array(p)).alias("taken"),
        ))
        return F.element_at(moved, 1)

    plan = table.select(
        "_s",
        "_period",
        F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("_period") - 1), state, take, lambda a: a["taken"]).alias("_taken"),
    )
    flat = plan.select("_s", "_period", F.posexplode("_taken").alias("_slot", "_i"))
    flat = flat.select(
        F.get("_s", F.col("_i"))["_source"].alias("_source"), F.get("_s", F.col("_i"))["_w"].alias("_w"), "_slot", "_period"
    )
    turn = F.row_number().over(Window.partitionBy("_source").orderBy("_slot")) - 1
    return flat.withColumn("_turn", turn)


def temperature_weights(sizes: DataFrame, period: int = PERIOD) -> DataFrame:
    """(_source, _w) from (_source, _n): shares by the square root of the number of rows."""
    total = F.sum(F.floor(F.sqrt("_n"))).over(Window.partitionBy(F.lit(1)))
    return sizes.select("_source", F.greatest(F.lit(1), F.floor(period * F.floor(F.sqrt("_n")) / total)).cast("long").alias("_w"))


def scheduled(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "doc_id",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every row with its place in the mix: id, source, source_rank, block, slot, place (and ``carry``).

    ``weights`` maps sources to whole target weights (others get 1); by default sources weigh as the
    square root of their size, rounded to slots of the period: shares are kept to about 1 / PERIOD, and
    a source below that has one slot. Rows are mixed in order of (slot, place). All rows stay: once a source
    has run out its slots stay empty, and the others keep their proportions.

    A null source is the source ''. Rows with equal ids are told apart by order alone, null ids rank
    as the id ''. An empty table gives no rows; clashing names do no harm.
    """
    private_names(docs, id_col, source_col)
    sizes = docs.groupBy(_source(F.col(source_col)).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        w = temperature_weights(sizes)
    else:
        given = F.lit(1)
        for name, value in weights.items():
            given = F.when(F.col("_source") == name, F.lit(value)).otherwise(given)
        w = sizes.select("_source", given.cast("long").alias("_w"))
    plan = checkpointed(slots(w))
    rows = ranked(docs, id_col, source_col, carry).withColumn("_block", F.floor(F.col("_rank") / block_rows))
    # The plan has a row for each slot of the period; beyond a checked size both joins are shuffles.
    small = F.broadcast if plan.count() <= BROADCAST_SLOTS else (lambda df: df)
    rows = rows.join(small(w.select("_source", "_w")), "_source").withColumn("_turn", F.pmod("_block", "_w").cast("int"))
    rows = rows.join(small(plan.select("_source", "_turn", "_slot", "_period")), ["_source", "_turn"])
    slot = F.floor(F.col("_block") / F.col("_w")) * F.col("_period") + F.col("_slot")
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias("source"),
        F.col("_rank").cast("long").alias("source_rank"),
        F.col("_block").cast("long").alias("block"),
        slot.cast("long").alias("slot"),
        F.pmod("_rank", F.lit(block_rows)).cast("long").alias("place"),
        *[F.col(f"_c_{c}").alias(f"_c_{c}") for c in carry],
    )


def placed(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` in the order of the mix, with ``slot`` and ``place``, which keep that order in files.

    Columns of ``docs`` with these names are kept under longer ones (``slot_``).
    """
    named = {c: c for c in docs.columns}
    for c in docs.columns:
        if c.lower() in ("slot", "place"):
            named[c] = c + "_"
            while named[c].lower() in {x.lower() for x in [*docs.columns, *[v for k, v in named.items() if k != c]]}:
                named[c] += "_"
    out = _in_order(docs, weights, block_rows, id_col, source_col)
    return out.select(*[F.col(c if c == id_col else f"_c_{c}").alias(named[c]) for c in docs.columns], "slot", "place")


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` in the order of the mix, columns unchanged."""
    out = _in_order(docs, weights, block_rows, id_col, source_col)
    return out.select(*[F.col(c if c == id_col else f"_c_{c}").alias(c) for c in docs.columns])


def _in_order(docs: DataFrame, weights: dict[str, int] | None, block_rows: int, id_col: str, source_col: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c != id_col)
    return scheduled(docs, weights, block_rows, id_col, source_col, carry=others).orderBy("slot", "place")
