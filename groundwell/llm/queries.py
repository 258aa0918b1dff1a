"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    branch_merge,
    exact_dedup,
    fill_in_middle,
    hilbert_shards,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    quality_rules,
    sentencepiece_codec,
    substring_dedup,
    token_counts,
    toxicity,
)
from .runtime import read_table

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir), n=4, percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), model_path())


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymised(documents(spark, sf_dir), key=os.environ.get("GROUNDWELL_PII_KEY", "demonstration key"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_substrings(documents(spark, sf_dir)).drop("spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(documents(spark, sf_dir))


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.checked(documents(spark, sf_dir), model_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    chain = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    # Toxic texts are rare, and texts without any sign of it score far below this.
    return toxicity.scored(documents(spark, sf_dir), labels, chain, threshold={"toxic": 0.3})


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.sharded(documents(spark, sf_dir)).drop("curve")


def coded_edits(rows: DataFrame, branch: str) -> branch_merge.Edits:
    """Edits that follow from checksums of branch, id and the name of what is edited."""
    code = lambda key, name: F.pmod(F.crc32(F.concat(F.lit(f"{branch}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), name).cast("binary")), F.lit(11))
    mark = lambda c, first: F.when(c == first, "!").when(c == first + 1, "?")

    def column(key, name, old):
        c = code(key, F.lit(name))
        return F.when(c == 0, "").otherwise(F.concat(old, F.coalesce(mark(c, 1), F.lit(""))))

    def lines(key, old):
        codes = F.transform(old, lambda _, i: code(key, i.cast("string")))
        new = lambda x, c: F.when(c <= 2, branch_merge.edit(F.when(c > 0, F.concat(x, mark(c, 1)))))
        return F.zip_with(old, codes, lambda x, c: F.when(c <= 4, F.struct(new(x, c).alias("edit"), mark(c, 3).alias("gap"))))

    own = code(F.col("_id"), F.lit("row"))
    first = -1 if branch == "L" else -2
    added = rows.select((F.lit(first) - F.col("_id")).alias("doc_id"), mark(own, 3).alias("text"), F.col("_c_lang").alias("lang"), F.col("_c_source").alias("source"))
    return branch_merge.Edits(lambda key: code(key, F.lit("row")) == 0, column, lines, added=added.where("text IS NOT NULL AND doc_id IS NOT NULL"))


def op12_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = branch_merge.merged(documents(spark, sf_dir), lambda rows: coded_edits(rows, "L"), lambda rows: coded_edits(rows, "R"))
    return m.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fill_in_middle.transformed(documents(spark, sf_dir))
    back = fill_in_middle.restored(F.col("form"), F.col("output"))
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_exact_dedup,
        op3_token_counts,
        op4_pii_surrogates,
        op5_suffix_array_dedup,
        op6_line_dedup,
        op7_sentencepiece_codec,
        op8_toxicity,
        op9_source_mixing,
        op10_quality_rules,
        op11_hilbert_shards,
        op12_branch_merge,
        op13_fill_in_middle,
    )
}
