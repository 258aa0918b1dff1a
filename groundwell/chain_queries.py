"""Registered queries of the chained question-answering plans and of the sources, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import config as C
from . import storage
from .functions import scores, text
from .operators import citations, consistency, context, dialogue, reply, retrieval
from .plans import answers, pipeline
from .plans.counts import Counts
from .queries import _API, _BASE, _BRANCHES, _COS, _LABEL, _RULES, _SAID, _api, _requests, chunks, register, table
from .sources import http

SYSTEMS = ("rules of the original", "rules of the variants")
_ASK = "'[참고자료]' || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[상담 질문]' || chr(10) || query || chr(10) || chr(10) || '위 참고자료를 바탕으로 지정된 답변 형식에 따라 답변해 주세요.'"
_ZERO = "k % 5 = 2"
#: Sessions: every third is asked again, and every other of those does not answer.
_SESSIONS = """
n AS (SELECT doc_id AS question_id, doc_id // 100 AS k FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 100 = 0),
se AS (SELECT question_id, k, 'question ' || question_id || CASE WHEN k % 4 = 1 THEN ' 딥페이크' ELSE '' END AS first,
         'question ' || question_id || CASE WHEN k % 4 = 1 THEN ' 딥페이크' ELSE '' END || CASE WHEN k % 6 = 0 THEN ' more ' || question_id || ' again' ELSE '' END AS query,
         k % 6 = 3 AS partial_mode, CASE WHEN k % 6 = 0 THEN 4 ELSE 3 + k % 3 END AS score FROM n)"""
#: The first branches of ``_BASE`` over the questions of the sessions; an expanded question has the next vector, some have none.
_SEARCHED = _BRANCHES.replace(_BASE, _BASE.replace(
    "q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0)",
    _SESSIONS + f""",
q AS (SELECT question_id AS query_id, CASE WHEN {_ZERO} THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS embedding
      FROM se JOIN embeddings ON vec_id = question_id + CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END)""",
)).replace("{n}", "3") + "," + _API + f""",
mm AS (SELECT query_id, score, source_type, text, {_LABEL} AS label, chunk_key::VARCHAR || '_' || (r - 1) AS chunk_id,
         CASE WHEN source_type IN ('statute', 'manual') THEN {_LABEL} ELSE '[판결문] court 2024 선고 case ' || chunk_key || ' [' || source || ']' END AS head, 0 AS o, position AS p FROM h WHERE position <= 9
       UNION ALL SELECT query_id, score, source_type, text, '', chunk_id, '[Open API] ' || law_name || ' ' || art, 1, r FROM ac WHERE (query_id // 100) % 5 != 2),
mn AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(text, 100) ORDER BY o, p) AS f FROM mm),
mk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, p) AS place FROM mn WHERE f = 1),
mo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE source_type WHEN 'statute' THEN 0 WHEN 'law_api' THEN 1 WHEN 'verdict' THEN 2 WHEN 'manual' THEN 3 ELSE 4 END, place) AS i FROM mk WHERE place <= 11),
mx AS (SELECT query_id, string_agg('[출처 ' || i || '] ' || head || ' (유사도: ' || printf('%.2f', score) || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS t,
         string_agg(chunk_id, '|' ORDER BY place) AS used FROM mo GROUP BY query_id),
cx AS (SELECT query_id AS question_id, used, CASE WHEN length(t) > 8000 THEN left(t, 8000) || chr(10) || chr(10) || '[... 컨텍스트 일부 생략 ...]' ELSE t END AS context FROM mx),
qs AS (SELECT question_id, k, 0 AS variant_idx, query FROM se UNION ALL SELECT question_id, k, i, 'variant ' || i || ' of ' || question_id FROM se, range(1, 11) t(i)),
pr AS (SELECT qs.*, context FROM qs LEFT JOIN cx USING (question_id))"""


def _turns(spark, sf):
    """Sessions of the stated questions: what was said and the model's judgement of it."""
    d = table(spark, sf, "documents").where("doc_id % 100 = 0").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    k = F.expr("doc_id div 100")
    said = lambda turn, x, score: F.struct(F.lit(turn).alias("turn"), x.alias("text"), score.alias("score"))
    first = F.concat(F.lit("question "), "doc_id", F.when(k % 4 == 1, " 딥페이크").otherwise(""))
    again = F.when(k % 3 == 0, said(1, F.when(k % 2 == 0, F.concat(F.lit("more "), "doc_id")).otherwise(""), F.lit(2).cast("long")))
    last = F.when(k % 6 == 0, said(2, F.lit("again"), F.lit(4).cast("long")))
    t = d.select(F.col("doc_id").alias("session_id"), F.explode(F.array_compact(F.array(said(0, first, 3 + k % 3), again, last))).alias("t"))
    judged = F.to_json(F.struct(F.col("t.score").alias("score"), F.lit("노동").alias("legal_category"), F.array(F.lit("a")).alias("missing_elements")))
    return t.select("session_id", "t.turn", "t.text", judged.alias("reply"))


def _similar(questions):
    listed = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("variant "), i.cast("string"), F.lit(" of "), F.col("question_id").cast("string")))
    return questions.select("question_id", F.to_json(F.struct(listed.alias("questions"))).alias("reply"))


def _embed(spark, sf):
    """The embedding model of the fixture takes the vector that a text's number names, the next one for expanded questions."""

    def run(texts):
        asks = F.startswith("text", F.lit("question"))
        number = F.regexp_extract("text", r"(\d+)", 1).cast("long")
        named = texts.select("id", asks.alias("asks"), number.alias("n"), (number + F.when(asks & F.contains("text", F.lit("특례법")), 1).otherwise(0)).alias("vec_id"))
        vectors = named.join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
        none = F.transform("embedding", lambda x: F.lit(0).cast("float"))
        return vectors.select("id", F.when(F.col("asks") & (F.expr("n div 100") % 5 == 2), none).otherwise(F.col("embedding")).alias("embedding"))

    return run


def _replies(prompts):
    """The model of the fixture: cites two articles and tells how long its prompt was; some variants answer nothing, blanks or not at all."""
    k, v = F.expr("question_id div 100"), F.col("variant_idx")
    article = lambda m: F.pmod(k * m, F.lit(400)).cast("string")
    said = F.concat(
        F.lit("(1) 쟁점\n답 형법 제"), article(37), F.lit("조, 근로기준법 제"), article(91), F.lit("조 "), v.cast("string"),
        F.repeat(F.lit(" 판단"), F.pmod(k + v, F.lit(3)).cast("int")), F.lit("\n(4) 유의 "), F.length(F.get("messages", F.lit(1))["content"]).cast("string"),
    )
    some = F.when(F.pmod(k + v, F.lit(7)) == 6, "").when(F.pmod(k + v, F.lit(13)) == 12, " \n ").otherwise(said)
    return prompts.where(F.pmod(k + v, F.lit(11)) != 10).select("question_id", "variant_idx", some.alias("answer"))


def _metrics(pairs):
    """Scores of the fixture: lengths of cores, and numbers of question and variant; every sixth question lacks one."""
    k, v = F.expr("question_id div 100"), F.col("variant_idx")
    steady = k % 6 == 5
    a, b = F.length("reference_core"), F.length("answer_core")
    token = F.when(steady, 0.8).otherwise(F.floor(F.least(a, b) * 25 / F.greatest(a, b)) / 25)
    near = F.when(~(steady & (v == 3)), (15 + F.pmod(k + v * 3, F.lit(11))) / 25)
    said = F.when(steady, "0.80").when(k % 4 == 3, "0.04").otherwise(F.concat(F.lit("점수: "), ((10 + F.pmod(k * 7 + v, F.lit(16))) / 25).cast("decimal(3,2)").cast("string")))
    judged = consistency.judge_scores(pairs.select("question_id", "variant_idx", said.alias("reply")))
    return pairs.select("question_id", "variant_idx", token.alias("token"), near.alias("embedding")).join(judged, ["question_id", "variant_idx"])


def _models(spark, sf):
    return pipeline.Models(_similar, _embed(spark, sf), _replies, _metrics)


def _statute_rows(spark, sf):
    return _api(spark, sf).where(F.expr("query_id div 100") % 5 != 2)


def _questions(spark, sf):
    return pipeline.asked(_turns(spark, sf))


def _contexts(spark, sf):
    return context.contexts(pipeline.searched(_questions(spark, sf), chunks(spark, sf), _embed(spark, sf), _statute_rows(spark, sf)))


def _prompts(spark, sf):
    s = _questions(spark, sf)
    v = _similar(s).select("question_id", F.posexplode(dialogue.variants(F.col("reply"))).alias("_i", "query"))
    q = s.select("question_id", F.lit(0).alias("variant_idx"), "query").unionByName(v.select("question_id", (F.col("_i") + 1).alias("variant_idx"), "query"))
    return storage.stored(pipeline.prompts(q, _contexts(spark, sf), *SYSTEMS))


@register(f"WITH {_SESSIONS} SELECT question_id, first, query, partial_mode, score::INTEGER AS score, '노동' AS legal_category FROM se")
def asked_questions(spark, sf):
    return _questions(spark, sf).select("question_id", "first", "query", "partial_mode", "specificity.score", "specificity.legal_category")


@register(f"WITH {_SEARCHED} SELECT question_id, variant_idx, CASE WHEN context IS NOT NULL THEN CASE variant_idx WHEN 0 THEN '{SYSTEMS[0]}' ELSE '{SYSTEMS[1]}' END END AS system, CASE WHEN context IS NOT NULL THEN {_ASK} END AS ask, CASE WHEN context IS NULL AND variant_idx = 0 THEN '{C.NO_HITS_PARALLEL}' END AS answer FROM pr")
def variant_prompts(spark, sf):
    p = _prompts(spark, sf)
    return p.select("question_id", "variant_idx", F.get("messages", F.lit(0))["content"].alias("system"), F.get("messages", F.lit(1))["content"].alias("ask"), "answer")


_SAID_TO = f"""CASE WHEN (k + variant_idx) % 11 = 10 THEN NULL WHEN (k + variant_idx) % 7 = 6 THEN '' WHEN (k + variant_idx) % 13 = 12 THEN ' ' || chr(10) || ' '
  ELSE '(1) 쟁점' || chr(10) || core || chr(10) || '(4) 유의 ' || length({_ASK}) END"""
_CORE = "'답 형법 제' || (k * 37 % 400) || '조, 근로기준법 제' || (k * 91 % 400) || '조 ' || variant_idx || repeat(' 판단', ((k + variant_idx) % 3)::INT)"


@register(f"WITH {_SEARCHED}, sa AS (SELECT *, {_CORE} AS core FROM pr WHERE variant_idx = 0) SELECT question_id, CASE WHEN context IS NOT NULL THEN {_ASK} END AS ask, CASE WHEN context IS NULL THEN '{C.NO_HITS_SINGLE}' ELSE {_SAID_TO} END AS answer FROM sa")
def single_path(spark, sf):
    """One question without variants, from its words to its answer."""
    p = pipeline.single_answered(_questions(spark, sf).select("question_id", "query"), _contexts(spark, sf), SYSTEMS[0], _replies, storage.fresh(spark, "answers"))
    return p.select("question_id", F.get("messages", F.lit(1))["content"].alias("ask"), "answer")


@register("SELECT conv_id * 1000 + turn AS question_id, 'rules' AS system, text AS ask, CASE WHEN (conv_id * 1000 + turn) // 100 % 11 != 10 THEN length(text) END AS n FROM conversations")
def ungrounded_prompts(spark, sf):
    """Questions that are put to a model without references, and the length that its answer tells."""
    q = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("query"))
    made = storage.stored(pipeline.ungrounded(q, "rules"))
    tell = lambda p: p.where(F.expr("question_id div 100") % 11 != 10).select("question_id", "variant_idx", F.length(F.get("messages", F.lit(1))["content"]).cast("string").alias("answer"))
    said = answers.answered(made, tell, storage.fresh(spark, "answers"))
    j = made.drop("answer").join(said, ["question_id", "variant_idx"])
    part = lambda i: F.get("messages", F.lit(i))["content"]
    return j.select("question_id", part(0).alias("system"), part(1).alias("ask"), F.col("answer").cast("long").alias("n"))


_ANSWERS = _SEARCHED + f""",
an AS (SELECT question_id, k, variant_idx, core, CASE WHEN context IS NULL THEN CASE WHEN variant_idx = 0 THEN '{C.NO_HITS_PARALLEL}' END ELSE {_SAID_TO} END AS answer FROM (SELECT *, {_CORE} AS core FROM pr)),
og AS (SELECT question_id, k, answer AS reference, core AS reference_core FROM an WHERE variant_idx = 0 AND answer != ''),
pa AS (SELECT question_id, og.k, variant_idx, reference, answer, CASE WHEN trim(reference) = chr(10) THEN '' ELSE reference_core END AS reference_core, core AS answer_core
       FROM an JOIN og USING (question_id) WHERE variant_idx > 0 AND trim(replace(answer, chr(10), ' ')) != '')"""


def _answers(spark, sf):
    made = _prompts(spark, sf)
    return storage.stored(pipeline.answered(made, answers.answered(made, _replies, storage.fresh(spark, "answers"))))


@register(f"WITH {_ANSWERS} SELECT question_id, variant_idx, reference, answer, reference_core, answer_core FROM pa")
def answer_pairs(spark, sf):
    return consistency.cores(consistency.pairs(_answers(spark, sf)))


@register(f"WITH {_ANSWERS}, lo AS (SELECT question_id, variant_idx, repeat(reference, 20) AS reference, repeat(answer, 20) AS answer, row_number() OVER (PARTITION BY question_id ORDER BY variant_idx) AS n FROM pa) SELECT question_id, variant_idx, left(reference, 600) AS reference, left(answer, 600) AS answer FROM lo WHERE n <= 5")
def judge_inputs(spark, sf):
    long = consistency.pairs(_answers(spark, sf)).select("question_id", "variant_idx", F.repeat("reference", F.lit(20)).alias("reference"), F.repeat("answer", F.lit(20)).alias("answer"))
    return consistency.judge_inputs(long)


_LAWS = ["근로기준법"]
#: The nearest statute of a citation's vector; citations whose number names no vector have none.
_CITED_BY = """
ci AS (SELECT question_id, i AS ord, CASE i WHEN 0 THEN '형법 제' || (k * 37 % 400) || '조' ELSE '근로기준법 제' || (k * 91 % 400) || '조' END AS citation, CASE i WHEN 0 THEN k * 37 % 400 ELSE k * 91 % 400 END AS num
       FROM (SELECT DISTINCT question_id, k, reference FROM {given}) o, (VALUES (0), (1)) t(i) WHERE reference LIKE '(1)%' ),
nq AS (SELECT DISTINCT num, e.embedding FROM ci JOIN embeddings e ON e.vec_id = num),
nd AS (SELECT num, c.chunk_key, c.text, """ + _COS.replace("q.embedding", "nq.embedding") + """ AS dist FROM nq, c WHERE c.source_type = 'statute'),
nn AS (SELECT num, arg_min(text, (dist, chunk_key)) AS text, min(dist) AS dist FROM nd GROUP BY num)"""


@register(f"WITH {_ANSWERS}, {_CITED_BY.format(given='og')} SELECT citation, round(1 - any_value(dist), 4) AS score FROM ci JOIN nn USING (num) GROUP BY citation")
def citation_nearest(spark, sf):
    original = _answers(spark, sf).where("variant_idx = 0")
    cited = original.select(F.explode(text.citations(F.col("answer"))).alias("citation")).distinct()
    vectors = _embed(spark, sf)(cited.select(F.xxhash64("citation").alias("id"), F.col("citation").alias("text")))
    named = cited.withColumn("id", F.xxhash64("citation")).join(vectors, "id").select("citation", "embedding")
    return citations.nearest(named, chunks(spark, sf)).select("citation", scores.similarity(F.col("dist")).alias("score"))


def _full(spark, sf):
    laws = spark.createDataFrame([(x,) for x in _LAWS], "law_name string")
    return pipeline.full(_turns(spark, sf), chunks(spark, sf), _models(spark, sf), laws, SYSTEMS, storage.fresh(spark, "answers"), _statute_rows(spark, sf))


_FULL = f"""WITH {_ANSWERS},
me AS (SELECT question_id, k, variant_idx, CASE WHEN k % 6 = 5 THEN 0.8 ELSE floor(least(length(reference_core), length(answer_core)) * 25 / greatest(length(reference_core), length(answer_core))) / 25 END::DOUBLE AS token,
         CASE WHEN NOT (k % 6 = 5 AND variant_idx = 3) THEN (15 + (k + variant_idx * 3) % 11) / 25 END::DOUBLE AS near,
         CASE WHEN k % 6 = 5 THEN 0.8 WHEN k % 4 = 3 THEN 0.04 ELSE (10 + (k * 7 + variant_idx) % 16) / 25 END::DOUBLE AS said, row_number() OVER (PARTITION BY question_id ORDER BY variant_idx) AS nth FROM pa),
mj AS (SELECT *, CASE WHEN nth <= 5 THEN round(said, 4) ELSE round(avg(CASE WHEN nth <= 5 THEN round(said, 4) END) OVER (PARTITION BY question_id), 4) END AS judge,
         count(near) OVER (PARTITION BY question_id) = count(*) OVER (PARTITION BY question_id) AS whole FROM me),
ms AS (SELECT question_id, round(CASE WHEN whole THEN 0.25 * token + 0.4 * near + 0.35 * judge ELSE 0.25 / 0.6 * token + 0.35 / 0.6 * judge END, 4) AS s FROM mj),
gr AS (SELECT question_id, round(median(s), 4) AS s, count(*) AS n FROM ms GROUP BY question_id),
ok AS (SELECT og.* FROM og JOIN gr USING (question_id) WHERE s >= 0.75),
{_CITED_BY.format(given="ok")},
ck AS (SELECT question_id, ord, citation, text, coalesce(round(1 - dist, 4) >= 0.7, FALSE) OR ord = 1 AS ok FROM ci LEFT JOIN nn USING (num)),
cc AS (SELECT question_id, coalesce(string_agg(citation, '|' ORDER BY ord) FILTER (ok), '') AS found, coalesce(string_agg(citation, '|' ORDER BY ord) FILTER (NOT ok), '') AS missing,
         max(CASE WHEN NOT ok AND text IS NOT NULL THEN citation END) AS wrong, max(CASE WHEN NOT ok AND text IS NOT NULL THEN string_split(left(text, 200), chr(10))[1] END) AS good FROM ck GROUP BY question_id),
st2 AS (SELECT se.question_id, se.k, first, query, score, reference, se.partial_mode, coalesce(gr.s, 0.0)::DOUBLE AS median_f1, coalesce(gr.s, 0.0) >= 0.75 AS passed, coalesce(gr.n, 0) AS n_scores, found, missing, wrong, good, context, used
        FROM se LEFT JOIN og USING (question_id) LEFT JOIN gr USING (question_id) LEFT JOIN cc USING (question_id) LEFT JOIN cx USING (question_id)),
fu AS (SELECT *, CASE WHEN reference IS NULL THEN 'no_rag_result' WHEN NOT passed THEN 'hallucination_detected' WHEN partial_mode THEN 'partial_mode' ELSE 'success' END AS status FROM st2)"""


@register(_FULL + f""" SELECT question_id, status, CASE status WHEN 'no_rag_result' THEN '{C.NO_RESULT}' WHEN 'hallucination_detected' THEN '{C.REFUSAL}' ELSE CASE WHEN wrong IS NULL THEN reference ELSE replace(reference, wrong, good) END END AS final_answer,
median_f1, n_scores, coalesce(found, '') AS found, coalesce(missing, '') AS missing FROM fu""")
def full_pipeline(spark, sf):
    r = _full(spark, sf)
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return r.select("question_id", "status", "final_answer", "median_f1", F.size("all_scores").cast("long").alias("n_scores"), joined("found"), joined("missing"))


@register(_FULL + f""" SELECT question_id, status, first AS query, score::INTEGER AS score, partial_mode, status != 'no_rag_result' AS has_rag, status != 'no_rag_result' AS has_consistency, status IN ('success', 'partial_mode') AS has_citations,
CASE WHEN status IN ('success', 'partial_mode') THEN wrong END AS wrong, CASE WHEN status != 'no_rag_result' THEN median_f1 END AS median_f1, CASE WHEN status != 'no_rag_result' THEN reference END AS initial_answer,
CASE WHEN status != 'no_rag_result' THEN coalesce(context, '') END AS context, CASE WHEN status != 'no_rag_result' AND context IS NOT NULL THEN {_ASK} END AS ask, CASE WHEN status != 'no_rag_result' THEN coalesce(used, '') END AS chunks FROM fu""")
def result_layout(spark, sf):
    """The JSON of every result, read again: context, prompt and chunks of the original are the chain's own."""
    j = _full(spark, sf).transform(lambda r: r.select("question_id", pipeline.layout(r).alias("j")))
    at = lambda p: F.get_json_object("j", p)
    has = lambda k: F.array_contains(F.json_object_keys("j"), k)
    wrong = F.get(F.json_object_keys(at("$.citation_check.corrections")), F.lit(0))
    used = F.from_json(at("$.original_rag.retrieved_chunks"), "array<struct<chunk_id:string>>")
    return j.select(
        "question_id", at("$.status").alias("status"), at("$.query").alias("query"), at("$.specificity.score").cast("int").alias("score"), at("$.specificity.partial_mode").cast("boolean").alias("partial_mode"),
        has("original_rag").alias("has_rag"), has("consistency").alias("has_consistency"), (has("citation_check") & has("ner_check")).alias("has_citations"), wrong.alias("wrong"),
        at("$.consistency.median_f1").cast("double").alias("median_f1"), at("$.original_rag.initial_answer").alias("initial_answer"), at("$.original_rag.context_text").alias("context"),
        at("$.original_rag.prompt_messages[1].content").alias("ask"), F.array_join(F.transform(used, lambda c: c["chunk_id"]), "|").alias("chunks"),
    )


@register("""WITH w AS (SELECT conv_id, turn, role, text, coalesce(list(role || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)
SELECT conv_id, turn, array_to_string(list_concat(list_concat(['system:rules'], h[greatest(1, len(h) - 5):len(h)]), ['user:' || '[참고자료]' || chr(10) || 'ctx' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[상담 질문]' || chr(10) || text || chr(10) || chr(10) || '위 참고자료를 바탕으로 지정된 답변 형식에 따라 답변해 주세요.']), '|') AS messages FROM w""")
def history_prompt(spark, sf):
    # The cap of a history bounds what a turn can look back to.
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-C.DEFAULT.history_cap, -1)
    t = table(spark, sf, "conversations").withColumn("h", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w))
    m = dialogue.with_history(context.messages(F.lit("rules"), F.lit("ctx"), F.col("text")), F.col("h"))
    return t.select("conv_id", "turn", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("messages"))


_EXPANDED = "len(list_filter([" + ", ".join(f"regexp_matches(text, '{p}')" for p, _ in _RULES) + "], lambda x: x)) > 0"
_ASKED = _BASE.replace(
    "q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0)",
    f"q AS (SELECT a.doc_id AS query_id, e.embedding FROM documents a JOIN embeddings e ON e.vec_id = a.doc_id + CASE WHEN {_EXPANDED} THEN 1 ELSE 0 END WHERE a.doc_id % 100 = 0)",
)


@register("WITH " + _BRANCHES.replace(_BASE, _ASKED).replace("{n}", "5") + "," + _API + f""",
m AS (SELECT query_id, score, source_type, text, {_LABEL} AS label, 0 AS o, position AS p FROM h WHERE position <= 9
      UNION ALL SELECT query_id, score, source_type, text, '[Open API] ' || law_name || ' ' || art, 1, r FROM ac),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(text, 100) ORDER BY o, p) AS f FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, p) AS position FROM n WHERE f = 1)
SELECT query_id, CAST(position AS INT) AS rank, score, source_type, label, replace(left(text, 200), chr(10), ' ') AS preview FROM k WHERE position <= 11""")
def search_expanded(spark, sf):
    """Questions as texts: expanded, embedded (the fixture's model takes the next vector for an expanded text), searched with API rows."""
    d = table(spark, sf, "documents").where("doc_id % 100 = 0")
    wide = d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), text.expand_query(F.col("text"), _RULES).alias("expanded"))
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = wide.withColumn("vec_id", F.col("query_id") + F.when(F.col("query") != F.col("expanded"), 1).otherwise(0)).join(vectors, "vec_id").select("query_id", "embedding")
    return retrieval.search_only(asked, chunks(spark, sf), api=_api(spark, sf).join(asked.select("query_id"), "query_id", "left_semi"))


_ACK = json.dumps({"version": "2.0", "useCallback": True, "data": {"text": C.WAIT_ANSWER}}, ensure_ascii=False, separators=(",", ":"))


@register(f"SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '{C.WAIT_ANSWER}' END AS ack, CASE WHEN conv_id % 2 = 1 THEN role END AS direct, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 OR turn % 3 = 1 AND turn % 2 = 0 AND regexp_matches({_SAID}, '{'|'.join(C.IMAGE_WORDS)}') THEN '{C.CARD[0]}' END AS card, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 OR turn % 3 = 1 AND turn % 2 = 0 AND regexp_matches({_SAID}, '{'|'.join(C.IMAGE_WORDS)}') THEN 'http://image?v=1' END AS picture, role AS bubble FROM conversations")
def envelopes(spark, sf):
    said = F.when(F.col("turn") % 3 == 0, F.concat("r.utterance", F.lit(" 그림"))).otherwise(F.col("r.utterance"))
    t = _requests(spark, sf).join(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    image = F.when(F.col("turn") % 2 == 0, text.cache_buster(F.lit("http://image")))
    ack = reply.text_acknowledgement(F.col("r.callback_url"), F.col("role"))
    body = reply.illustrated(said, F.col("role"), image)
    bubbles = lambda p: F.coalesce(F.get_json_object(body, f"$.template.outputs[1]{p}"), F.get_json_object(body, f"$.template.outputs[0]{p}"))
    return t.select(
        "conv_id", "turn", F.get_json_object(ack, "$.data.text").alias("ack"), F.get_json_object(ack, "$.template.outputs[0].simpleText.text").alias("direct"),
        F.get_json_object(body, "$.template.outputs[0].basicCard.title").alias("card"),
        F.get_json_object(body, "$.template.outputs[0].basicCard.thumbnail.imageUrl").alias("picture"), bubbles(".simpleText.text").alias("bubble"),
    )


def _named(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("question_id"), F.concat(F.lit("question "), "doc_id").alias("query"))


def register_of_laws(kind, query):
    """A register for the fixture: laws by the question's number, some without rows, one at a time or in a list."""
    if kind == "laws":
        n = int(query["query"].split()[-1])
        if n % 5 == 4:
            raise OSError("no answer")
        rows = [{"법령ID": str(n % 50 + i), "법령명한글": f"law {n % 50 + i}"} for i in range(3)]
        return json.dumps({"LawSearch": {"law": rows[0] if n % 2 else rows}})
    n = int(query["ID"])
    return json.dumps({"법령": {"조문": {"조문단위": [{"조번호": str(i), "조제목": "t" if i % 2 else "", "조문내용": f"content {n}"} for i in range(1, 5)]}}})


@register("""WITH n AS (SELECT DISTINCT doc_id AS query_id FROM documents WHERE doc_id % 5 != 4),
l AS (SELECT query_id, i, (query_id % 50 + i)::VARCHAR AS law FROM n, (VALUES (0), (1)) t(i) WHERE i = 0 OR query_id % 2 = 0)
SELECT query_id, 'api_' || law || '_' || a AS chunk_id, '【law ' || law || '】 제' || a || '조' || CASE WHEN a % 2 = 1 THEN ' (t)' ELSE '' END || chr(10) || 'content ' || law AS text FROM l, (VALUES (1), (2)) t(a)""")
def statute_search(spark, sf):
    q = _named(spark, sf).select(F.col("question_id").alias("query_id"), "query")
    laws, articles = http.statutes(q, f"{__name__}.register_of_laws")
    return retrieval.api_chunks(laws, articles, per_law=C.DEFAULT.retrieve_api_articles).select("query_id", "chunk_id", "text")


@register(f"WITH {_BASE}, {_API} SELECT query_id, count(*) AS n_chunks, string_agg(DISTINCT law_name, '|' ORDER BY law_name) AS laws FROM ac GROUP BY query_id")
def retrieval_summary(spark, sf):
    return retrieval.summary(_api(spark, sf)).select("query_id", "n_chunks", F.array_join("laws", "|").alias("laws"))


@register(f"WITH {_ANSWERS} SELECT question_id, left(coalesce(nullif(answer, ''), 'fallback of ' || question_id), 500) AS answer FROM an WHERE variant_idx = 0")
def answer_fallback(spark, sf):
    own = _answers(spark, sf).where("variant_idx = 0")
    return own.select("question_id", reply.reply_text(F.lit("asked"), F.col("answer"), F.concat(F.lit("fallback of "), "question_id")).alias("answer"))


def fixture_client():
    """A model that fails on questions whose number ends in 7, whoever asks."""

    def ask(messages):
        said = messages[-1]["content"]
        if said.rstrip().split(" ")[-1].endswith("7"):
            raise OSError("no answer")
        return f"{messages[0]['content']}: {said}"

    return ask


_CLIENT = f"{__name__}.fixture_client"


@register("SELECT doc_id AS question_id, 0 AS variant_idx, CASE WHEN doc_id % 10 != 7 THEN 'rules: question ' || doc_id END AS answer FROM documents")
def model_replies(spark, sf):
    s = _named(spark, sf)
    m = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit("rules")), ("user", F.col("query")))])
    return http.complete(s.select("question_id", F.lit(0).alias("variant_idx"), m.alias("messages")), _CLIENT, backoff=0.0, strict=False)


@register("SELECT doc_id AS question_id, CASE WHEN doc_id % 10 != 7 THEN 'draw: see: question ' || doc_id END AS prompt FROM documents")
def image_prompts(spark, sf):
    return http.image_prompts(_named(spark, sf).select("question_id", F.col("query").alias("text")), _CLIENT, ("see", "draw"), backoff=0.0)


@register(_FULL + """ SELECT stage, name, value::BIGINT AS value FROM (
SELECT 'questions' AS stage, 'rows' AS name, (SELECT count(*) FROM se) AS value UNION ALL SELECT 'questions', 'partial', (SELECT count(*) FROM se WHERE partial_mode)
UNION ALL SELECT 'hits', 'rows', (SELECT count(*) FROM mo) UNION ALL SELECT 'hits', 'from_' || s, (SELECT count(*) FROM mo WHERE source_type = s) FROM (VALUES ('statute'), ('law_api'), ('verdict'), ('manual')) t(s)
UNION ALL SELECT 'prompts', 'rows', (SELECT count(*) FROM pr) UNION ALL SELECT 'prompts', 'asked', (SELECT count(context) FROM pr) UNION ALL SELECT 'prompts', 'apologies', (SELECT count(*) FROM pr WHERE context IS NULL AND variant_idx = 0)
UNION ALL SELECT 'answers', 'rows', (SELECT count(*) FROM an) UNION ALL SELECT 'answers', 'missing', (SELECT count(*) FROM an WHERE answer IS NULL)
UNION ALL SELECT 'scored', 'rows', (SELECT count(*) FROM gr) UNION ALL SELECT 'scored', 'passed', (SELECT count(*) FROM gr WHERE s >= 0.75))""")
def run_counts(spark, sf):
    """What each stage of the chain has seen, observed as it ran."""
    counts, laws = Counts(), spark.createDataFrame([(x,) for x in _LAWS], "law_name string")
    r = pipeline.full(_turns(spark, sf), chunks(spark, sf), _models(spark, sf), laws, SYSTEMS, storage.fresh(spark, "answers"), _statute_rows(spark, sf), counts=counts)
    return counts.table(r)


@register("SELECT p_name AS name, p_brand AS display_name FROM part WHERE p_size % 3 = 0")
def model_catalogue(spark, sf):
    methods = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("embedContent"), F.lit("generateContent"))).otherwise(F.array(F.lit("embedContent")))
    return http.usable_models(table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("display_name"), methods.alias("methods")))


@register("SELECT conv_id || '-' || turn AS request_id, text AS image FROM conversations WHERE turn % 4 != 3 AND text != ''")
def image_parts(spark, sf):
    part = lambda x, d: F.struct(x.alias("text"), d.alias("inline_data"))
    none, data = F.lit(None).cast("string"), F.base64(F.encode("text", "utf-8"))
    parts = F.when(F.col("turn") % 4 == 3, F.array(part(F.lit("sorry"), none))).otherwise(F.array(part(F.lit("here"), none), part(none, data), part(none, F.base64(F.lit("second").cast("binary")))))
    t = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), parts.alias("parts"))
    return http.images(t).select("request_id", F.decode("image", "utf-8").alias("image"))
