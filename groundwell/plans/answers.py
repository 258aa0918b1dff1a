"""A table of what models have answered: each prompt is asked once, by whichever stage or run comes first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

KEY = ["question_id", "variant_idx", "digest"]
SCHEMA = "question_id long, variant_idx int, digest string, answer string"
#: Prompts of one round. What a round has answered is kept even if the job fails after it.
ROUND = 10_000
#: Rounds of one call at most; more prompts make longer rounds.
ROUNDS = 64


def digests(prompts: DataFrame) -> DataFrame:
    """``prompts`` with the digest of their messages: another prompt for the same variant is another request."""
    return prompts.withColumn("digest", F.sha2(F.to_json("messages"), 256))


def known(spark: SparkSession, path: str) -> DataFrame:
    """What the table holds; nothing, where there is none yet."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def answered(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame], path: str, round_prompts: int = ROUND) -> DataFrame:  # L1, C8
    """question_id, variant_idx, answer of all prompts, read from the table in ``path``.

    ``ask`` takes prompts (question_id, variant_idx, messages) to replies (question_id, variant_idx, answer).
    Prompts that the table lacks are asked in rounds and appended to it; a round is written whole or not at
    all. Every reader after that, and every run after a failure, reads the table: no stage asks again.
    A prompt that got no reply has a null answer and is not asked again either. A task that is repeated
    within a round asks its prompts again, as no one can tell what its first try has heard.

    One writer a path at a time. Prompts without messages are left out; repeated prompts are asked once.
    """
    spark = prompts.sparkSession
    wanted = digests(prompts.where("messages IS NOT NULL").select("question_id", "variant_idx", "messages"))
    missing = storage.stored(wanted.join(known(spark, path).select(*KEY), KEY, "left_anti").dropDuplicates(KEY))
    rounds = min(ROUNDS, -(-missing.count() // round_prompts))
    for i in range(rounds):
        part = missing.where(F.pmod(F.xxhash64(*KEY), F.lit(rounds)) == i)
        said = ask(part.drop("digest")).select("question_id", "variant_idx", "answer").dropDuplicates(["question_id", "variant_idx"])
        told = part.select(*KEY).join(said, ["question_id", "variant_idx"], "left")
        told.select("question_id", F.col("variant_idx").cast("int").alias("variant_idx"), "digest", "answer").write.mode("append").parquet(path)
    rows = wanted.select(*KEY).dropDuplicates(KEY)
    return known(spark, path).join(rows, KEY, "left_semi").select("question_id", "variant_idx", "answer")
