"""Verification of citations and the correction fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text
from .retrieval import knn


#: Answers that cite the same are spread over this many parts.
SALTS = 8


def nearest(citations: DataFrame, chunks: DataFrame) -> DataFrame:  # J5
    """citation, dist, text: the nearest statute of each citation (citation, embedding), asked once."""
    asked = citations.select("citation", "embedding").dropDuplicates(["citation"]).withColumn("query_id", F.xxhash64("citation"))
    found = knn(asked, chunks, 1, "statute").select("query_id", "chunk_key", "dist")
    texts = chunks.select("chunk_key", "text").join(found, "chunk_key")
    return asked.select("query_id", "citation").join(texts, "query_id").select("citation", "dist", "text")


def verified(citations: DataFrame, hits: DataFrame, laws: DataFrame, config: Config = DEFAULT) -> DataFrame:  # J5
    """answer_id, found, missing, corrections.

    citations: answer_id, ord, citation. hits: citation, dist, text of its best statute, where there
    is one. laws: law_name of the confirming register. A name that the register knows makes a
    citation found and drops its correction.
    """
    known = laws.select(F.col("law_name").alias("_law")).distinct().withColumn("_known", F.lit(True))
    # Few citations are in many answers: each is decided once, and those who cite it are dealt out by salt.
    own = citations.select("citation").distinct().join(hits.select("citation", "dist", F.col("text").alias("_hit")), "citation", "left")
    own = own.withColumn("_law", text.law_name(F.col("citation"))).join(known, "_law", "left")
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    c = citations.withColumn("_salt", F.pmod(F.xxhash64("answer_id"), F.lit(SALTS)).cast("int")).join(own, ["citation", "_salt"])
    near = F.coalesce(F.round(1 - F.col("dist"), 4) >= config.citation_threshold, F.lit(False))
    c = c.withColumn("_found", near | F.coalesce("_known", F.lit(False)))
    right = F.when(~F.col("_found") & F.col("_hit").isNotNull(), F.left("_hit", F.lit(config.correction_chars)))
    c = c.withColumn("_right", right)

    def listed(keep: Column, value: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(keep, F.struct("ord", value.alias("v")))))
        return F.transform(rows, lambda x: x["v"])

    return c.groupBy("answer_id").agg(
        listed(F.col("_found"), F.col("citation")).alias("found"),
        listed(~F.col("_found"), F.col("citation")).alias("missing"),
        listed(F.col("_right").isNotNull(), F.struct(F.col("citation").alias("wrong"), F.col("_right").alias("right"))).alias("corrections"),
    )


def corrected(answer: Column, citation_pairs: Column, entity_pairs: Column | None = None) -> Column:  # C7
    """Replacements one after the other, citations before entities; later pairs see earlier results.

    Only the first line of a replacement is used.
    """
    none = F.array().cast("array<struct<wrong:string,right:string>>")
    pairs = F.concat(F.coalesce(citation_pairs, none), F.coalesce(entity_pairs, none) if entity_pairs is not None else none)
    return F.aggregate(pairs, answer, lambda acc, p: F.replace(acc, p["wrong"], F.element_at(F.split(p["right"], "\n"), 1)))


def entity_check(path: str | None = None) -> Column:  # L5
    """Extension point: no entity model is part of this engine, so nothing is corrected."""
    none = F.array().cast("array<struct<wrong:string,right:string>>")
    return F.struct(none.alias("corrections"), F.lit(path is None).alias("is_stub"))
