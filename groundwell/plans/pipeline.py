"""The whole answer pipeline over tables of model outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from .. import storage
from ..functions import text
from ..operators import citations, consistency, context, dialogue, retrieval
from .answers import answered as stored_answers
from .counts import Counts


def status(original_answer: Column, passed: Column, partial: Column) -> Column:  # C3
    return (
        F.when(F.coalesce(original_answer, F.lit("")) == "", "no_rag_result")
        .when(~F.coalesce(passed, F.lit(False)), "hallucination_detected")
        .when(F.coalesce(partial, F.lit(False)), "partial_mode")
        .otherwise("success")
    )


def final_answer(state: Column, corrected: Column) -> Column:
    return F.when(state == "no_rag_result", C.NO_RESULT).when(state == "hallucination_detected", C.REFUSAL).otherwise(corrected)


def prompts(questions: DataFrame, contexts: DataFrame, system: str, variant_system: str, apology: str = C.NO_HITS_PARALLEL) -> DataFrame:  # J7, L9
    """question_id, variant_idx, query, messages, answer: one prompt for each variant.

    questions: question_id, variant_idx (0: the original), query. All variants of a question share the
    context of the original; the original has the first system text and its variants the second. A
    question without context has an apology for the original's answer and no prompts.
    """
    j = questions.join(contexts.select(F.col("query_id").alias("question_id"), "context"), "question_id", "left")
    own = F.when(F.col("variant_idx") == 0, F.lit(system)).otherwise(F.lit(variant_system))
    return j.select(
        "question_id", "variant_idx", "query",
        F.when(F.col("context").isNotNull(), context.messages(own, F.col("context"), F.col("query"))).alias("messages"),
        F.when(F.col("context").isNull() & (F.col("variant_idx") == 0), apology).alias("answer"),
    )


def ungrounded(questions: DataFrame, system: str) -> DataFrame:  # L9
    """question_id, variant_idx, query, messages, answer of questions that are put to a model without references."""
    q = questions.withColumn("messages", context.plain_messages(F.lit(system), F.col("query"))).withColumn("answer", F.lit(None).cast("string"))
    return q.select("question_id", F.lit(0).alias("variant_idx"), "query", "messages", "answer")


def single(questions: DataFrame, contexts: DataFrame, system: str) -> DataFrame:  # C9
    """The path of one question without variants: its prompt, or the apology of this path."""
    return prompts(questions.withColumn("variant_idx", F.lit(0)), contexts, system, system, C.NO_HITS_SINGLE).drop("variant_idx")


def single_answered(questions: DataFrame, contexts: DataFrame, system: str, complete: Callable[[DataFrame], DataFrame], table: str) -> DataFrame:  # C9
    """question_id, query, messages, answer: the same path to its end; the model is asked for what the answer table lacks."""
    made = storage.stored(single(questions, contexts, system).withColumn("variant_idx", F.lit(0)))
    said = answered(made, stored_answers(made, complete, table))
    return made.drop("answer").join(said, ["question_id", "variant_idx"]).drop("variant_idx")


def answered(prompts: DataFrame, replies: DataFrame) -> DataFrame:  # L1, C6
    """question_id, variant_idx, answer: the model's replies, apologies where there was no prompt.

    replies: question_id, variant_idx, answer. A variant that failed has no answer.
    """
    r = replies.select("question_id", "variant_idx", F.col("answer").alias("_reply"))
    j = prompts.join(r, ["question_id", "variant_idx"], "left")
    return j.select("question_id", "variant_idx", F.coalesce("answer", F.when(F.col("messages").isNotNull(), F.col("_reply"))).alias("answer"))


def results(questions: DataFrame, answers: DataFrame, pairs: DataFrame, checked: DataFrame) -> DataFrame:  # C8
    """question_id, status, final_answer, median_f1, passed.

    questions: question_id, partial_mode; answers: question_id, variant_idx, answer; pairs: metric
    scores; checked: answer_id, found, missing, corrections.
    """
    return settled(questions, answers, consistency.ensemble(pairs), checked)


def settled(questions: DataFrame, answers: DataFrame, ensembles: DataFrame, checked: DataFrame) -> DataFrame:  # C8
    """``results`` from scores that are there already (of ``consistency.ensemble``)."""
    original = answers.where("variant_idx = 0").select("question_id", "answer")
    scored = consistency.all_questions(questions, ensembles)
    j = questions.join(original, "question_id", "left").join(scored, "question_id")
    j = j.join(checked.withColumnRenamed("answer_id", "question_id"), "question_id", "left")
    state = status(F.col("answer"), F.col("passed"), F.col("partial_mode"))
    return j.select(
        *[c for c in ("query",) if c in questions.columns], "question_id", state.alias("status"),
        final_answer(state, citations.corrected(F.col("answer"), F.col("corrections"))).alias("final_answer"),
        "answer", "median_f1", "all_scores", "passed", "found", "missing", "corrections",
    )


@dataclass(frozen=True)
class Models:
    """What models do in the chain, each from a table to a table, never called twice for one row.

    variants: (question_id, query) to (question_id, reply), a reply that lists similar questions.
    embed: (id, text) to (id, embedding); texts without a vector are left out. complete: (question_id,
    variant_idx, messages) to (question_id, variant_idx, answer). metrics: pairs (question_id, variant_idx,
    reference, answer, reference_core, answer_core) to (question_id, variant_idx, token, embedding, judge).
    """

    variants: Callable[[DataFrame], DataFrame]
    embed: Callable[[DataFrame], DataFrame]
    complete: Callable[[DataFrame], DataFrame]
    metrics: Callable[[DataFrame], DataFrame]


def asked(turns: DataFrame, config: C.Config = C.DEFAULT) -> DataFrame:  # C1, P14
    """question_id, first, query, partial_mode, specificity from turns (session_id, turn, text, reply).

    ``first`` is what was asked first, ``query`` what re-asking made of it, ``specificity`` the last check that
    the session came to, parsed from its reply.
    """
    t = turns.withColumn("_s", dialogue.specificity(F.col("reply"), config)).withColumn("score", F.col("_s.score"))
    loop = dialogue.session_loop(t.select("session_id", "turn", "text", "score"), config)
    # An unanswered re-ask has no check: the one before it stands.
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))
    said = t.withColumn("_nth", nth).join(loop.select("session_id", F.col("checks").alias("_n")), "session_id").where(F.col("_nth") <= F.col("_n"))
    first = F.min_by("text", "turn").alias("first")
    last = said.groupBy("session_id").agg(first, F.max_by("_s", "turn").alias("specificity"))
    return loop.join(last, "session_id").select(F.col("session_id").alias("question_id"), "first", F.col("question").alias("query"), "partial_mode", "specificity")


def searched(questions: DataFrame, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], api: DataFrame | None = None, config: C.Config = C.DEFAULT, counts: Counts | None = None) -> DataFrame:  # C8, C9
    """Hits of every question (question_id, query): expanded, embedded, searched, merged with statute rows, stored once."""
    texts = questions.select(F.col("question_id").alias("id"), text.expand_query(F.col("query")).alias("text"))
    vectors = embed(texts).select(F.col("id").alias("query_id"), "embedding")
    hits = retrieval.with_api(retrieval.retrieve(vectors, chunks, config=config), api, config)
    kinds = {f"from_{k}": F.count_if(F.col("source_type") == k) for k in context.AUTHORITY}
    return storage.stored(hits if counts is None else counts.watched("hits", hits, **kinds))


def full(
    turns: DataFrame, chunks: DataFrame, models: Models, laws: DataFrame, systems: tuple[str, str], table: str, api: DataFrame | None = None, config: C.Config = C.DEFAULT,
    bad: str | None = None, counts: Counts | None = None,
) -> DataFrame:  # C8
    """The whole chain from turns (session_id, turn, text, reply) to results, a row a session.

    Specificity and re-asking, similar questions, one search of the original question, prompts of all variants
    over its context, answers, consistency, the gate, citations of what passed, corrections, status. ``table``
    is the folder of the answer table: models are asked for what it lacks, every later stage reads
    it. ``laws`` confirms citations by name; ``api`` holds statute rows by query_id. A question without hits
    ends with an apology, which has no variants and so does not pass.

    Sessions with a check that has no readable score are set aside; with ``bad`` their bad turns are
    added to the table in that folder. ``counts`` gathers what each stage has seen.

    Besides the columns of ``results``: first, specificity, context, messages and chunks of the original.
    """
    counts = Counts() if counts is None else counts
    sound, unreadable = dialogue.set_aside(turns, config)
    if bad is not None:
        counts.watched("bad turns", unreadable).write.mode("append").parquet(bad)
    questions = storage.stored(counts.watched("questions", asked(sound, config), partial=F.count_if("partial_mode")))
    listed = models.variants(questions.select("question_id", "query")).select("question_id", dialogue.variants(F.col("reply"), config.variants).alias("questions"))
    similar = listed.select("question_id", F.posexplode("questions").alias("_i", "query")).select("question_id", (F.col("_i") + 1).alias("variant_idx"), "query")
    hits = searched(questions, chunks, models.embed, api, config, counts)
    contexts = context.contexts(hits, config)
    all_prompts = prompts(questions.select("question_id", F.lit(0).alias("variant_idx"), "query").unionByName(similar), contexts, *systems)
    made = storage.stored(counts.watched("prompts", all_prompts, asked=F.count("messages"), apologies=F.count("answer")))
    answers = storage.stored(counts.watched("answers", answered(made, stored_answers(made, models.complete, table)), missing=F.count_if(F.col("answer").isNull())))
    scores = consistency.ensemble(models.metrics(consistency.cores(consistency.pairs(answers))), config)
    scored = storage.stored(counts.watched("scored", scores, passed=F.count_if("passed")))
    passed = scored.where("passed").select("question_id")
    original = answers.where("variant_idx = 0").where(F.coalesce("answer", F.lit("")) != "").join(passed, "question_id", "left_semi")
    cited = original.select(F.col("question_id").alias("answer_id"), F.posexplode(text.citations(F.col("answer"))).alias("ord", "citation"))
    vectors = models.embed(cited.select(F.col("citation").alias("text"), F.xxhash64("citation").alias("id")).distinct())
    named = cited.select("citation").distinct().join(vectors.withColumnRenamed("id", "_id"), F.xxhash64("citation") == F.col("_id")).select("citation", "embedding")
    checked = citations.verified(cited, citations.nearest(named, chunks), laws, config)
    r = settled(questions, answers, scored, checked)
    shown = made.where("variant_idx = 0").select("question_id", "messages").join(contexts.withColumnRenamed("query_id", "question_id"), "question_id", "left")
    shown = shown.join(_chunks(hits), "question_id", "left")
    return r.join(questions.select("question_id", "first", "specificity", "partial_mode"), "question_id").join(shown, "question_id", "left")


def _chunks(hits: DataFrame) -> DataFrame:
    """question_id and its hits in their order; a hit's metadata is a map and so is kept beside what is sorted."""
    rows = F.collect_list(F.struct("position", F.struct("chunk_id", "text", "score", "source_type", "metadata").alias("c")))
    by_place = F.array_sort(rows, lambda a, b: a["position"] - b["position"])
    return hits.groupBy(F.col("query_id").alias("question_id")).agg(F.transform(by_place, lambda x: x["c"]).alias("chunks"))


def layout(r: DataFrame) -> Column:  # P23
    """The JSON of a result of ``full``: sections that its status did not reach are left out."""
    reached = F.col("status") != "no_rag_result"
    passed = F.col("status").isin("success", "partial_mode")
    s = F.col("specificity")
    named = [s[x].alias(x) for x in ("score", "entities", "legal_category", "legal_issue", "missing_elements", "is_sufficient")]
    none = F.array().cast("array<string>")
    sections = {
        "specificity": F.when(s.isNotNull(), F.struct(*named, F.col("partial_mode"))),
        "original_rag": F.when(reached, F.struct(
            F.col("query"), F.col("answer").alias("initial_answer"), F.coalesce("context", F.lit("")).alias("context_text"),
            F.coalesce("messages", F.array().cast(r.schema["messages"].dataType)).alias("prompt_messages"),
            F.coalesce("chunks", F.array().cast(r.schema["chunks"].dataType)).alias("retrieved_chunks"),
        )),
        "consistency": F.when(reached, F.struct("median_f1", "all_scores", "passed")),
        "citation_check": F.when(passed, F.struct(
            F.coalesce("found", none).alias("found"), F.coalesce("missing", none).alias("missing"),
            F.map_from_entries(F.coalesce("corrections", F.array().cast("array<struct<wrong:string,right:string>>"))).alias("corrections"),
        )),
        "ner_check": F.when(passed, F.struct(citations.entity_check()["corrections"].alias("corrections"), citations.entity_check()["is_stub"].alias("is_stub"))),
    }
    return result_json(F.struct(F.col("first").alias("query"), "final_answer", "status"), sections)


def result_json(top: Column, sections: dict[str, Column]) -> Column:  # P23
    """Nested JSON: fields of ``top``, then each section that is not null. Null leaves stay."""
    keep = {"ignoreNullFields": "false"}
    head = F.to_json(top, keep)
    parts = [F.when(s.isNotNull(), F.concat(F.lit(f',"{name}":'), F.to_json(s, keep))).otherwise(F.lit("")) for name, s in sections.items()]
    return F.concat(F.expr("'{'"), F.substring(head, F.lit(2), F.length(head) - 2), *parts, F.lit("}"))
