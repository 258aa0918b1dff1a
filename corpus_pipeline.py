"""Corpus preparation: quality rules, exact and near deduplication, mixing, piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundwell.llm import exact_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from groundwell.llm.queries import model_path
from groundwell.llm.runtime import deleted, scratch, stage_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and look like their language; the others go.

    Short documents are no worse for it, so only those without words go for their length. Null and empty
    texts have none. Repeated rows get equal verdicts; no rows give no rows.
    """
    return quality_rules.kept_rows(docs, min_words=1)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the row with the smallest doc_id; of equal ids one row."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (Jaccard 0.8) the one with the smallest doc_id.

    Texts without words and rows without an id are linked with nothing and stay.
    """
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and place in the mix; a null source is the source ''."""
    return mixing.placed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, source, slot and place of every document; null texts have no ids."""
    return sentencepiece_codec.encoded(docs, model_path(), carry=("source", "slot", "place"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram jaccard join", near),
    ("source mixing", mix),
    ("sentencepiece codec", encode),
]

#: Viterbi encoding has no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again.

    What a stage has stored, and the table before it, go when its own table is written; the last stays.

    Files do not keep the order of rows: ``slot`` and ``place`` of the result give the order of the mix.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = stage_folder(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return docs
