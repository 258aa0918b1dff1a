"""Exact deduplication by skew-safe combining (native DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import WS, checkpointed, free_name, private_names

#: Digest groups are first merged within this many salts, so that one text held by a third of all
#: rows is spread over as many tasks.
SALTS = 64


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty. Single spaces are left alone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D][{WS}]*|\x20[{WS}]+", " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    salts: int = SALTS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (and ``row``, a struct of ``carry``).

    Three stages, each comparing whole normalised texts and never digests alone: map-side combining
    removes local copies, the second stage merges the rows of one (digest, salt), the third combines
    the salts' winners. Members then look their winner up by (digest, salt). Digests that stand for
    several texts (a collision) are looked up by content.

    Null text is the empty text. Of rows with the same id and the same text one is kept. Null ids
    never win against other ids; a group of null ids only keeps one row and has a null keep_id.
    Other columns are ignored, so clashing names do no harm. An empty table gives no rows.
    """
    private_names(docs, id_col, text_col)
    row = [F.struct(*[F.col(c) for c in carry]).alias("_row")] if carry else []
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"), *row)
    rows = rows.withColumn("_digest", digest(F.col("_text"))).withColumn(
        "_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")
    )
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.min("_id").alias("_min"), F.count(F.lit(1)).alias("_n"))
    # At most one row per salt and text is left: a group's rows number no more than the salts.
    merged = (
        salted.repartition("_digest")
        .groupBy("_digest", "_text")
        .agg(
            F.min("_min").alias("_keep"),
            F.sum("_n").alias("_size"),
            F.collect_list("_salt").alias("_salts"),
        )
    )
    variants = F.count(F.lit(1)).over(Window.partitionBy("_digest"))
    winners = merged.withColumn("_variants", variants).select(
        "_digest",
        "_keep",
        "_size",
        "_salts",
        F.when(F.col("_variants") > 1, F.col("_text")).alias("_clash_text"),
    )
    winners = checkpointed(winners)
    clean = winners.where(F.col("_clash_text").isNull())
    lookup = clean.select("_digest", F.explode("_salts").alias("_salt"), "_keep", "_size")
    light = rows.drop("_text")
    clash = winners.where(F.col("_clash_text").isNotNull())
    if clash.isEmpty():
        found = light.join(lookup, ["_digest", "_salt"])
    else:
        clashing = clash.select("_digest").distinct()
        by_text = rows.join(
            clash.select("_digest", F.explode("_salts").alias("_salt"), F.col("_clash_text").alias("_text"), "_keep", "_size"),
            ["_digest", "_salt", "_text"],
        ).drop("_text")
        found = light.join(clashing, "_digest", "left_anti").join(lookup, ["_digest", "_salt"]).unionByName(by_text)
    # Rows of one id share a salt, so this window needs no further exchange and no hot partition.
    nth = F.row_number().over(Window.partitionBy("_digest", "_salt", "_keep", "_id").orderBy(F.col("_id")))
    return found.withColumn("_nth", nth).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"),
        F.col("_digest").alias("text_sha256"),
        *([F.col("_row").alias("row")] if carry else []),
    )


#: Digests of repeated texts are broadcast up to this many (16 MB), else joined by a shuffle.
BROADCAST_DIGESTS = 1_000_000


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; ``exact_groups`` says which.

    64-bit digests are counted first. A digest that occurs once is a text that occurs once: such rows
    stay where they are. Only rows whose digest repeats go through the three stages, which compare
    whole texts, so digests decide nothing but which rows need no comparing.
    """
    private_names(docs, id_col, text_col)
    name = free_name(docs, "_digest64")
    rows = docs.withColumn(name, F.xxhash64(normalised(F.col(text_col))))
    often = checkpointed(rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(name))
    if often.count() <= broadcast_digests:
        often = F.broadcast(often)
    alone = rows.join(often, name, "left_anti").select(*docs.columns)
    again = rows.join(often, name, "left_semi").select(*docs.columns)
    kept = exact_groups(again, id_col, text_col, carry=tuple(docs.columns)).where("kept")
    return alone.unionByName(kept.select("row.*"))
