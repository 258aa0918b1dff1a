"""Consistency of candidate answers: pairwise metrics, weighted ensemble, median gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions import scores, text

METRICS = ("token", "embedding", "judge")


def judge_scores(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:  # L4, A2
    """question_id, variant_idx, judge: the first pairs are judged, the others get the judged mean."""
    by = Window.partitionBy("question_id")
    nth = F.row_number().over(by.orderBy("variant_idx"))
    p = pairs.withColumn("_s", F.when(nth <= config.judged_pairs, scores.judged(F.col("reply"))))
    return p.select("question_id", "variant_idx", F.coalesce("_s", F.round(F.avg("_s").over(by), 4)).alias("judge"))


def pairs(answers: DataFrame) -> DataFrame:  # P28, L9
    """question_id, variant_idx, reference, answer: each variant's answer beside the original's (variant 0).

    Null answers, an empty original and blank variants are left out, so a question may have fewer pairs, or none.
    """
    original = answers.where("variant_idx = 0").where(F.coalesce("answer", F.lit("")) != "").select("question_id", F.col("answer").alias("reference"))
    others = answers.where("variant_idx > 0").where(text.strip(F.coalesce("answer", F.lit(""))) != "")
    return others.join(original, "question_id").select("question_id", "variant_idx", "reference", "answer")


def cores(pairs: DataFrame) -> DataFrame:  # P10
    """Pairs with the cores of both texts, as token and embedding scores read them; judges read the texts themselves."""
    core = lambda c: text.core_text(F.col(c)).alias(f"{c}_core")
    return pairs.select("*", core("reference"), core("answer"))


def judge_inputs(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:  # L4
    """question_id, variant_idx, reference, answer of the pairs that are judged, cut to what the judge reads."""
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("variant_idx"))
    cut = lambda c: F.left(F.col(c), F.lit(config.judge_chars)).alias(c)
    return pairs.withColumn("_nth", nth).where(F.col("_nth") <= config.judged_pairs).select("question_id", "variant_idx", cut("reference"), cut("answer"))


def ensemble(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:  # A1, A3, A4, C5
    """question_id, median_f1, all_scores, passed from pairs (question_id, variant_idx, token, embedding, judge).

    A metric counts for a question only if every pair has it; weights are normalised over those. If
    none counts the question passes with 1 and has no scores.
    """
    by = Window.partitionBy("question_id")
    there = {m: F.count(m).over(by) == F.count(F.lit(1)).over(by) for m in METRICS}
    p = pairs.select("*", *[there[m].alias(f"_{m}") for m in METRICS])
    total = sum((F.when(F.col(f"_{m}"), F.lit(config.weights[m])).otherwise(F.lit(0.0)) for m in METRICS), F.lit(0.0))
    p = p.withColumn("_total", total)
    terms = [F.when(F.col(f"_{m}"), F.lit(config.weights[m]) / F.col("_total") * F.col(m)).otherwise(F.lit(0.0)) for m in METRICS]
    score = F.when(F.col("_total") > 0, F.round(sum(terms, F.lit(0.0)), 4)).otherwise(F.lit(1.0))
    p = p.withColumn("_score", score)
    scored = F.when(F.col("_total") > 0, F.struct("variant_idx", "_score"))
    listed = F.transform(F.array_sort(F.collect_list(scored)), lambda x: x["_score"])
    out = p.groupBy("question_id").agg(F.round(F.median("_score"), 4).alias("median_f1"), listed.alias("all_scores"))
    return out.withColumn("passed", F.col("median_f1") >= config.consistency_threshold)


def all_questions(questions: DataFrame, scored: DataFrame) -> DataFrame:  # C4
    """Questions without a pair score 0 and do not pass."""
    none = F.array().cast("array<double>")
    j = questions.select("question_id").join(scored, "question_id", "left")
    return j.select(
        "question_id",
        F.coalesce("median_f1", F.lit(0.0)).alias("median_f1"),
        F.coalesce("all_scores", none).alias("all_scores"),
        F.coalesce("passed", F.lit(False)).alias("passed"),
    )
