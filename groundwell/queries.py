"""Registered queries of the question-answering operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import config as C
from . import storage
from .functions import laws as law_names
from .functions import rules, scores, text
from .operators import citations, consistency, context, dialogue, reply, retrieval, vector_index
from .plans import pipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table over the fixtures: vectors with the texts of equal ids, source by label."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    source = F.when(F.col("label") % 3 == 0, "statute").when(F.col("label") % 3 == 1, "manual").otherwise("verdict")
    meta = F.create_map(
        F.lit("law_name"), F.concat(F.lit("law "), F.col("label").cast("string")), F.lit("article_id"), F.concat(F.lit("art "), F.col("vec_id").cast("string")),
        F.lit("part"), F.lit("part"), F.lit("section_label"), F.col("lang"), F.lit("case_number"), F.concat(F.lit("case "), F.col("vec_id").cast("string")),
        F.lit("section_type"), F.col("source"), F.lit("court"), F.lit("court"), F.lit("decision_date"), F.lit("2024"),
    )
    return e.join(d, e.vec_id == d.doc_id).select(
        F.col("vec_id").alias("chunk_key"), F.col("vec_id").cast("string").alias("doc_id"), "embedding", "text", source.alias("source_type"), meta.alias("metadata")
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_COS = """(1 - list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
  / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) + 1e-9))"""
_BASE = f"""
q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS chunk_key, embedding, text, lang, source, label,
        CASE label % 3 WHEN 0 THEN 'statute' WHEN 1 THEN 'manual' ELSE 'verdict' END AS source_type
      FROM embeddings JOIN documents ON vec_id = doc_id),
d AS (SELECT query_id, chunk_key, source_type, {_COS} AS dist FROM q, c)"""
_BRANCHES = _BASE + """,
b AS (
  SELECT *, 0 AS bo, 'verdict' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_key) AS r FROM d
  UNION ALL SELECT *, 1, 'statute', row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_key) FROM d WHERE source_type = 'statute'
  UNION ALL SELECT *, 2, 'manual', row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_key) FROM d WHERE source_type = 'manual'),
t AS (SELECT b.query_id, b.chunk_key, b.bo, b.branch, b.r, round(1 - dist, 4) AS score, c.text, c.lang, c.source, c.label,
        CASE WHEN branch = 'verdict' THEN c.source_type ELSE branch END AS source_type
      FROM b JOIN c USING (chunk_key) WHERE r <= {n} AND round(1 - dist, 4) >= 0.3),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(text, 100) ORDER BY bo, r) AS f FROM t),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bo, r) AS position FROM u WHERE f = 1)"""
_LABEL = """trim(CASE source_type WHEN 'statute' THEN '[법령] law ' || label || ' art ' || chunk_key
  WHEN 'manual' THEN '[매뉴얼] part ' || lang ELSE '[판결문] case ' || chunk_key || ' ' || source END)"""


@register(f"WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_key) AS rank FROM d) SELECT query_id, chunk_key, CAST(rank AS INT) AS rank, round(1 - dist, 4) AS score FROM r WHERE rank <= 10")
def knn_topk(spark, sf):
    return retrieval.knn(questions(spark, sf), chunks(spark, sf), 10).select("query_id", "chunk_key", "rank", scores.similarity(F.col("dist")).alias("score"))


@register(f"WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_key) AS rank FROM d WHERE source_type = 'statute') SELECT query_id, chunk_key, CAST(rank AS INT) AS rank, round(1 - dist, 4) AS score FROM r WHERE rank <= 3")
def knn_filtered(spark, sf):
    return retrieval.knn(questions(spark, sf), chunks(spark, sf), 3, "statute").select("query_id", "chunk_key", "rank", scores.similarity(F.col("dist")).alias("score"))


@register(f"WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_key) AS rank FROM d) SELECT query_id, chunk_key, round(1 - dist, 4) AS score FROM r WHERE rank <= 20 AND round(1 - dist, 4) >= 0.3")
def knn_threshold(spark, sf):
    found = retrieval.knn(questions(spark, sf), chunks(spark, sf), 20)
    return found.select("query_id", "chunk_key", scores.similarity(F.col("dist")).alias("score")).where(F.col("score") >= C.DEFAULT.score_threshold)


@register()
def knn_approximate(spark, sf):
    """The ten nearest in the lists that an inverted file searches, by their true distances; ``knn_index_recall`` holds it against ``knn_topk``."""
    index = vector_index.built(chunks(spark, sf))
    return vector_index.search(index, questions(spark, sf), 10).select("query_id", "chunk_key", "rank", scores.similarity(F.col("dist")).alias("score"))


@register(f"WITH {_BASE}, b AS (SELECT query_id, chunk_key FROM d), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_key) AS n FROM b) SELECT count(*) AS n_exact, TRUE AS recalled, (SELECT count(*) FROM c) AS n_indexed FROM r WHERE n <= 10")
def knn_index_recall(spark, sf):
    """Whether the index holds every chunk and finds nine in ten of the ten nearest."""
    c, q = chunks(spark, sf), questions(spark, sf)
    index = vector_index.built(c)
    r = vector_index.recall(vector_index.search(index, q, 10), retrieval.topk(q, c, 10, [None]))
    n = index.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_indexed"))
    return r.select("n_exact", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("recalled")).join(n)


@register("WITH " + _BRANCHES.replace("{n}", "3") + " SELECT query_id, chunk_key::VARCHAR || '_' || (r - 1) AS chunk_id, source_type, score, CAST(position AS INT) AS position FROM h WHERE position <= 9")
def retrieve_merge(spark, sf):
    return retrieval.retrieve(questions(spark, sf), chunks(spark, sf)).select("query_id", "chunk_id", "source_type", "score", "position")


def _api(spark, sf):
    part = table(spark, sf, "part")
    laws = questions(spark, sf).select("query_id").withColumn("law", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    laws = laws.select("query_id", F.col("law").alias("ord"), (F.pmod("query_id", F.lit(100)) + F.col("law")).cast("string").alias("law_id"), F.concat(F.lit("law "), F.col("law").cast("string")).alias("law_name"))
    articles = part.select(
        F.pmod("p_partkey", F.lit(50)).cast("string").alias("law_id"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("string").alias("no"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("title"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("content"),
    )
    return retrieval.api_chunks(laws, articles, per_law=C.DEFAULT.retrieve_api_articles)


_API = """
al AS (SELECT q.query_id, l AS n, ((q.query_id % 100) + l)::VARCHAR AS law_id, 'law ' || l AS law_name FROM q, (SELECT unnest([1, 2]) AS l)),
aa AS (SELECT (p_partkey % 50)::VARCHAR AS law_id, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS m, p_size::VARCHAR AS no,
         CASE WHEN p_size % 2 = 0 THEN p_brand END AS title, CASE WHEN p_partkey % 3 != 0 THEN p_name END AS content FROM part),
ac AS (SELECT query_id, 'api_' || law_id || '_' || no AS chunk_id, '【' || law_name || '】 제' || no || '조' || coalesce(' (' || title || ')', '') || chr(10) || content AS text,
         0.8::DOUBLE AS score, 'law_api' AS source_type, law_name, '제' || no || '조' AS art, n * 1000 + m AS r FROM al JOIN aa USING (law_id) WHERE m <= 2 AND content IS NOT NULL)"""


@register(f"WITH {_BASE}, {_API} SELECT query_id, chunk_id, text, score, source_type FROM ac")
def api_chunks(spark, sf):
    return _api(spark, sf).select("query_id", "chunk_id", "text", "score", "source_type")


@register("WITH " + _BRANCHES.replace("{n}", "3") + "," + _API + """,
m AS (SELECT query_id, chunk_key::VARCHAR || '_' || (r - 1) AS chunk_id, text, score, source_type, 0 AS o, position AS p FROM h WHERE position <= 9
      UNION ALL SELECT query_id, chunk_id, text, score, source_type, 1, r FROM ac),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(text, 100) ORDER BY o, p) AS f FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, p) AS position FROM n WHERE f = 1)
SELECT query_id, chunk_id, source_type, score, CAST(position AS INT) AS position FROM k WHERE position <= 11""")
def retrieve_api_merge(spark, sf):
    hits = retrieval.retrieve(questions(spark, sf), chunks(spark, sf))
    return retrieval.with_api(hits, _api(spark, sf)).select("query_id", "chunk_id", "source_type", "score", "position")


@register("WITH " + _BRANCHES.replace("{n}", "5") + f" SELECT query_id, CAST(position AS INT) AS rank, score, source_type, {_LABEL} AS label, replace(left(text, 200), chr(10), ' ') AS preview FROM h WHERE position <= 9")
def search_only(spark, sf):
    return retrieval.search_only(questions(spark, sf), chunks(spark, sf))


@register("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY left(text, 100) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_prefix(spark, sf):
    return retrieval.first_by_prefix(table(spark, sf, "documents"), [], ["doc_id"]).select("doc_id")


_RULES = [("the.*and", "english text"), ("der|und", "german text"), ("que", "romance text"), ("idiot|moron", "insult"), ("token", "secret")]


@register("SELECT doc_id, CASE WHEN len(e) > 0 THEN trim(text || ' ' || array_to_string(e, ' ')) ELSE text END AS query FROM (SELECT doc_id, text, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{e}' END" for p, e in _RULES) + "], lambda x: x IS NOT NULL) AS e FROM documents)")
def expand_query(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.expand_query(F.col("text"), _RULES).alias("query"))


_KOREAN = ["직장내 성희롱 신고방법", "딥페이크 피해", "임금 체불과 수당", "해당 없음 ", "카메라 불법촬영 증거 확보"]
_ASKS = f"(SELECT conv_id, turn, text || ' ' || [{', '.join(repr(t) for t in _KOREAN)}][(conv_id + turn) % 5 + 1] AS text FROM conversations)"


@register("SELECT conv_id, turn, CASE WHEN len(e) > 0 THEN trim(text || ' ' || array_to_string(e, ' ')) ELSE text END AS query FROM (SELECT conv_id, turn, text, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{e}' END" for p, e in C.EXPANSIONS) + f"], lambda x: x IS NOT NULL) AS e FROM {_ASKS})")
def expand_query_rules(spark, sf):
    said = F.get(F.array(*[F.lit(t) for t in _KOREAN]), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)).cast("int"))
    t = table(spark, sf, "conversations").withColumn("q", F.concat("text", F.lit(" "), said))
    return t.select("conv_id", "turn", text.expand_query(F.col("q")).alias("query"))


@register("WITH " + _BRANCHES.replace("{n}", "3") + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE source_type WHEN 'statute' THEN 0 WHEN 'law_api' THEN 1 WHEN 'verdict' THEN 2 WHEN 'manual' THEN 3 ELSE 4 END, position) AS i FROM h WHERE position <= 9),
x AS (SELECT query_id, string_agg('[출처 ' || i || '] ' || CASE WHEN source_type IN ('statute', 'manual') THEN {_LABEL}
        ELSE '[판결문] court 2024 선고 case ' || chunk_key || ' [' || source || ']' END || ' (유사도: ' || printf('%.2f', score) || ')' || chr(10) || text,
        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS t FROM o GROUP BY query_id)
SELECT query_id, CASE WHEN length(t) > 8000 THEN left(t, 8000) || chr(10) || chr(10) || '[... 컨텍스트 일부 생략 ...]' ELSE t END AS context FROM x""")
def context_assembly(spark, sf):
    return context.contexts(retrieval.retrieve(questions(spark, sf), chunks(spark, sf)))


@register("SELECT conv_id, turn, 'system' AS role_1, 'rules' AS content_1, 'user' AS role_2, '[참고자료]' || chr(10) || role || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[상담 질문]' || chr(10) || text || chr(10) || chr(10) || '위 참고자료를 바탕으로 지정된 답변 형식에 따라 답변해 주세요.' AS content_2 FROM conversations")
def prompt_messages(spark, sf):
    m = context.messages(F.lit("rules"), F.col("role"), F.col("text"))
    t = table(spark, sf, "conversations").withColumn("m", m)
    return t.select("conv_id", "turn", *[F.get("m", F.lit(i))[k].alias(f"{k}_{i + 1}") for i in (0, 1) for k in ("role", "content")])


#: What is put before and after the texts of conversations, by turn.
_CORE = [("(1) 쟁점\n", "\n(2) 판단\n본문 둘\n본 답변은 참고용입니다"), ("① 결론\n", " \n\n대처 방안: 신고"), ("", " (4) 끝\n다음"), ("", "")]
_AROUND = lambda k: "[" + ", ".join("'" + c[k].replace("\n", "' || chr(10) || '") + "'" for c in _CORE) + "][turn % 4 + 1]"


@register(rf"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(t, '\([1-5]\)\s*[^\n]+\n?', '', 'g'), '[①-⑤]\s*', '', 'g'), '(?s)(\(4\)|\(5\)|대처 방안|유의사항|본 답변은 참고용).*$', ''), chr(10)), lambda x: trim(x)), lambda x: x != ''), ' ') AS core FROM (SELECT conv_id, turn, {_AROUND(0)} || text || {_AROUND(1)} AS t FROM conversations)")
def core_extract(spark, sf):
    around = lambda k: F.get(F.array(*[F.lit(c[k]) for c in _CORE]), F.pmod("turn", F.lit(4)).cast("int"))
    t = table(spark, sf, "conversations").withColumn("t", F.concat(around(0), "text", around(1)))
    return t.select("conv_id", "turn", text.core_text(F.col("t")).alias("core"))


def _pairs(spark, sf):
    """Every vector with the next of its label: its answer's variant."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("a"), F.lead("embedding").over(w).alias("b")).where("b IS NOT NULL")


_PAIRS = "p AS (SELECT * FROM (SELECT vec_id, label, embedding::DOUBLE[] AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[] AS b FROM embeddings) WHERE b IS NOT NULL), s AS (SELECT vec_id, label, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-9), 4) AS score FROM p)"


@register(f"WITH {_PAIRS} SELECT vec_id, score FROM s")
def pair_cosine(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(scores.cosine(F.col("a"), F.col("b")), 4).alias("score"))


def _tokens(c):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, F.lit(8)))


@register("""WITH p AS (SELECT * FROM (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[] AS b FROM embeddings) WHERE b IS NOT NULL),
x AS (SELECT vec_id, i, a[i * 8 + 1:i * 8 + 8] AS u FROM p, range(0, 8) t(i)), y AS (SELECT vec_id, i AS j, b[i * 8 + 1:i * 8 + 8] AS v FROM p, range(0, 8) t(i)),
c AS (SELECT vec_id, i, j, list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) + 1e-9) AS s FROM x JOIN y USING (vec_id)),
r AS (SELECT vec_id, avg(m) AS r FROM (SELECT vec_id, i, max(s) AS m FROM c GROUP BY ALL) GROUP BY vec_id), q AS (SELECT vec_id, avg(m) AS p FROM (SELECT vec_id, j, max(s) AS m FROM c GROUP BY ALL) GROUP BY vec_id)
SELECT vec_id, round(2 * p * r / (p + r), 4) AS f1 FROM r JOIN q USING (vec_id)""")
def token_f1(spark, sf):
    return _pairs(spark, sf).select("vec_id", scores.token_f1(_tokens(F.col("a")), _tokens(F.col("b"))).alias("f1"))


_REPLY = "CASE event_id % 6 WHEN 0 THEN '점수: ' || r WHEN 1 THEN r WHEN 2 THEN '-' || r WHEN 3 THEN '0.8.1' WHEN 4 THEN '.' ELSE 'none' END"


def _replies(spark, sf):
    r = (F.pmod("event_id", F.lit(37)) / 25).cast("decimal(10,2)").cast("string")
    k = F.pmod("event_id", F.lit(6))
    body = F.when(k == 0, F.concat(F.lit("점수: "), r)).when(k == 1, r).when(k == 2, F.concat(F.lit("-"), r)).when(k == 3, "0.8.1").when(k == 4, ".").otherwise("none")
    return table(spark, sf, "events").select("event_id", F.pmod("event_id", F.lit(97)).alias("question_id"), F.col("event_id").alias("variant_idx"), body.alias("reply"))


_JUDGED = f"j AS (SELECT event_id, (CASE WHEN x IS NULL THEN 0.5 ELSE round(greatest(0, least(1, x)), 4) END)::DOUBLE AS judge FROM (SELECT event_id, try_cast(regexp_extract(reply, '[0-9.]+') AS DOUBLE) AS x FROM (SELECT event_id, {_REPLY} AS reply FROM (SELECT event_id, CAST(CAST((event_id % 37) / 25.0 AS DECIMAL(10,2)) AS VARCHAR) AS r FROM events))))"


@register(f"WITH {_JUDGED} SELECT event_id, judge FROM j")
def judge_parse(spark, sf):
    return _replies(spark, sf).select("event_id", scores.judged(F.col("reply")).alias("judge"))


@register(f"WITH {_JUDGED}, n AS (SELECT event_id, event_id % 97 AS q, judge, row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id) AS i FROM j), a AS (SELECT q, round(avg(judge), 4) AS m FROM n WHERE i <= 5 GROUP BY q) SELECT q AS question_id, event_id AS variant_idx, CASE WHEN i <= 5 THEN judge ELSE m END AS judge FROM n JOIN a USING (q)")
def judge_pad(spark, sf):
    return consistency.judge_scores(_replies(spark, sf))


def _metrics(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    s = F.round(scores.cosine(F.col("a"), F.col("b")), 4)
    return _pairs(spark, sf).select(
        F.col("label").alias("question_id"), F.row_number().over(w).alias("variant_idx"),
        F.when(F.col("label") % 4 != 1, s).alias("token"), F.when(F.col("label") % 5 != 2, F.round((s + 1) / 2, 4)).alias("embedding"),
        F.when((F.col("label") % 3 != 0) | (F.col("vec_id") % 7 != 0), F.round(F.abs(s), 4)).alias("judge"),
    )


_ENSEMBLE = f"""WITH {_PAIRS}, m AS (SELECT label AS question_id, vec_id, CASE WHEN label % 4 != 1 THEN score END AS t, CASE WHEN label % 5 != 2 THEN round((score + 1) / 2, 4) END AS e,
  CASE WHEN label % 3 != 0 OR vec_id % 7 != 0 THEN round(abs(score), 4) END AS j FROM s),
g AS (SELECT question_id, CASE WHEN count(t) = count(*) THEN .25 ELSE 0 END::DOUBLE AS wt, CASE WHEN count(e) = count(*) THEN .4 ELSE 0 END::DOUBLE AS we, CASE WHEN count(j) = count(*) THEN .35 ELSE 0 END::DOUBLE AS wj FROM m GROUP BY 1),
x AS (SELECT question_id, CASE WHEN wt + we + wj > 0 THEN round(CASE WHEN wt > 0 THEN wt / (wt + we + wj) * t ELSE 0 END + CASE WHEN we > 0 THEN we / (wt + we + wj) * e ELSE 0 END + CASE WHEN wj > 0 THEN wj / (wt + we + wj) * j ELSE 0 END, 4) ELSE 1.0 END AS s FROM m JOIN g USING (question_id)),
y AS (SELECT question_id, round(median(s), 4) AS median_f1, count(*) AS n_scores FROM x GROUP BY 1)
SELECT question_id, median_f1, n_scores, median_f1 >= 0.75 AS passed FROM y"""


@register(_ENSEMBLE)
def ensemble_median_gate(spark, sf):
    return consistency.ensemble(_metrics(spark, sf)).select("question_id", "median_f1", F.size("all_scores").cast("long").alias("n_scores"), "passed")


def _cited(spark, sf):
    o = table(spark, sf, "orders")
    n = lambda k: F.pmod(F.col("o_orderkey") * k, F.lit(400)).cast("string")
    body = F.concat(F.lit("형법 제"), n(1), F.lit("조와 근로기준법 제"), n(3), F.lit("조의2 제1항, 또 형법 제"), n(1), F.lit("조"))
    return o.select("o_orderkey", text.citations(body).alias("c"))


_CITED = "c AS (SELECT o_orderkey, CASE WHEN i = 0 THEN '형법 제' || (o_orderkey % 400) || '조' ELSE '근로기준법 제' || ((o_orderkey * 3) % 400) || '조의2 제1항' END AS citation, i AS ord FROM orders, (VALUES (0), (1)) t(i))"


@register(f"WITH {_CITED} SELECT o_orderkey, CAST(ord AS INT) AS ord, citation, CASE WHEN ord = 0 THEN '형법' ELSE '근로기준법' END AS law FROM c")
def citation_extract(spark, sf):
    return _cited(spark, sf).select("o_orderkey", F.posexplode("c").alias("ord", "citation")).withColumn("law", text.law_name(F.col("citation")))


def _checked(spark, sf):
    c = _cited(spark, sf).select(F.col("o_orderkey").alias("answer_id"), F.posexplode("c").alias("ord", "citation"))
    n = F.regexp_extract("citation", r"제(\d+)조", 1).cast("long")
    p = table(spark, sf, "part").select(F.col("p_partkey"), F.concat("p_name", F.lit("\n"), "p_brand").alias("text"))
    hits = c.select("citation").distinct().withColumn("n", n).join(p, F.col("n") == F.col("p_partkey"))
    hits = hits.select("citation", (F.pmod("n", F.lit(10)) / 10).alias("dist"), "text")
    laws = spark.createDataFrame([("근로기준법",)], "law_name string")
    return citations.verified(c, hits, laws)


_VERIFY = f"""{_CITED}, k AS (SELECT o_orderkey AS answer_id, ord, citation, CAST(regexp_extract(citation, '제([0-9]+)조', 1) AS BIGINT) AS n FROM c),
v AS (SELECT k.*, p_name || chr(10) || p_brand AS hit, p_partkey IS NOT NULL AND round(1 - (n % 10) / 10, 4) >= 0.7 OR ord = 1 AS ok FROM k LEFT JOIN part ON n = p_partkey)"""


@register(f"WITH {_VERIFY} SELECT answer_id, coalesce(string_agg(citation, '|' ORDER BY ord) FILTER (ok), '') AS found, coalesce(string_agg(citation, '|' ORDER BY ord) FILTER (NOT ok), '') AS missing, coalesce(string_agg(citation || '>' || left(hit, 200), '|' ORDER BY ord) FILTER (NOT ok AND hit IS NOT NULL), '') AS corrections FROM v GROUP BY answer_id")
def citation_verify(spark, sf):
    v = _checked(spark, sf)
    fold = F.array_join(F.transform("corrections", lambda p: F.concat(p["wrong"], F.lit(">"), p["right"])), "|")
    return v.select("answer_id", F.array_join("found", "|").alias("found"), F.array_join("missing", "|").alias("missing"), fold.alias("corrections"))


@register(f"WITH {_VERIFY} SELECT answer_id, CASE WHEN max(CASE WHEN NOT ok AND hit IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN replace('see ' || max(CASE WHEN ord = 0 THEN citation END) || '!', max(CASE WHEN NOT ok AND hit IS NOT NULL THEN citation END), max(CASE WHEN NOT ok AND hit IS NOT NULL THEN string_split(hit, chr(10))[1] END)) ELSE 'see ' || max(CASE WHEN ord = 0 THEN citation END) || '!' END AS answer FROM v GROUP BY answer_id")
def apply_corrections(spark, sf):
    own = _cited(spark, sf).select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("see "), F.get("c", F.lit(0)), F.lit("!")).alias("a"))
    j = own.join(_checked(spark, sf), "answer_id", "left")
    return j.select("answer_id", citations.corrected(F.col("a"), F.col("corrections")).alias("answer"))


def _specific(spark, sf):
    k = F.pmod("event_id", F.lit(5))
    body = F.when(k == 0, F.lit("broken")).when(k == 1, F.to_json(F.struct(F.pmod("event_id", F.lit(7)).alias("score"), F.lit("노동").alias("legal_category")))).when(
        k == 2, F.to_json(F.struct(F.pmod("event_id", F.lit(7)).cast("string").alias("score"), F.lit("민사").alias("legal_category"), F.concat(F.lit("what happened in case "), "event_id").alias("followup_question")))
    ).when(k == 3, F.to_json(F.struct(F.lit("형사").alias("legal_category"), F.lit("short one").alias("followup_question")))).otherwise("{}")
    return table(spark, sf, "events").select("event_id", dialogue.specificity(body).alias("s"))


_SPEC = """s AS (SELECT event_id, CASE WHEN event_id % 5 IN (1, 2) THEN event_id % 7 ELSE 3 END AS score, CASE event_id % 5 WHEN 1 THEN '노동' WHEN 2 THEN '민사' WHEN 3 THEN '형사' ELSE '불명확' END AS cat,
  CASE WHEN event_id % 5 = 2 THEN 'what happened in case ' || event_id END AS f FROM events)"""
_TEMPLATE = lambda n: "CASE cat " + " ".join(f"WHEN '{c}' THEN [{', '.join(repr(t) for t in ts)}][({n}) % {len(ts)} + 1]" for c, ts in C.REASKS.items()) + " END"


@register(f"WITH {_SPEC} SELECT event_id, CAST(score AS INT) AS score, cat AS legal_category, score >= 4 AS is_sufficient, coalesce(f, {_TEMPLATE('0')}) AS followup FROM s")
def specificity_parse(spark, sf):
    return _specific(spark, sf).select("event_id", "s.score", "s.legal_category", "s.is_sufficient", F.col("s.followup_question").alias("followup"))


@register(f"WITH {_SPEC} SELECT event_id, coalesce(f, {_TEMPLATE('event_id % 4')}) AS ask FROM s")
def reask_choice(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 2, F.col("s.followup_question"))
    return _specific(spark, sf).select("event_id", dialogue.reask_text(raw, F.col("s.legal_category"), F.pmod("event_id", F.lit(4))).alias("ask"))


@register("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN role || '|q ' || conv_id WHEN 1 THEN 'a|' || role WHEN 2 THEN 'q ' || turn ELSE '' END AS questions FROM conversations")
def variant_parse(spark, sf):
    """Replies of a model: an object with the list, the list itself, an object with another key, and two without a list."""
    t, k = table(spark, sf, "conversations"), F.pmod("turn", F.lit(5))
    q = F.array(F.concat(F.lit(" "), "role", F.lit(" ")), F.lit(""), F.concat(F.lit("q "), F.col("conv_id").cast("string")))
    body = (
        F.when(k == 0, F.to_json(F.struct(q.alias("questions")))).when(k == 1, F.to_json(F.array(F.lit("a"), F.col("role"))))
        .when(k == 2, F.to_json(F.struct(F.array(F.concat(F.lit("q "), F.col("turn").cast("string"))).alias("list")))).when(k == 3, '{"n": 3}').otherwise("nothing")
    )
    return t.select("conv_id", "turn", F.array_join(dialogue.variants(body), "|").alias("questions"))


_LOOP = """WITH t AS (SELECT conv_id, turn, CASE WHEN turn > 0 AND (conv_id + turn) % 5 = 0 THEN '' ELSE text END AS text, (conv_id * 3 + turn) % 6 AS score FROM conversations WHERE turn <= 5),
u AS (SELECT *, turn > 0 AND trim(text) = '' AS e FROM t), v AS (SELECT *, coalesce(sum(CASE WHEN score >= 4 OR e THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM u)
SELECT conv_id AS session_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (NOT e), '') AS question, count(*) FILTER (NOT e) AS checks, arg_max(e OR score < 4, turn) AS partial_mode FROM v WHERE ended = 0 GROUP BY conv_id"""


@register(_LOOP)
def session_loop(spark, sf):
    t = table(spark, sf, "conversations")
    body = F.when((F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 5 == 0), "").otherwise(F.col("text"))
    checks = t.select(F.col("conv_id").alias("session_id"), "turn", body.alias("text"), ((F.col("conv_id") * 3 + F.col("turn")) % 6).alias("score"))
    return dialogue.session_loop(checks)


@register("""WITH w AS (SELECT conv_id, turn, text, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM conversations),
u AS (SELECT conv_id, turn, text, list_transform(list_filter(coalesce(h, []), lambda x: x.r = 'user'), lambda x: x.t) AS us FROM w)
SELECT conv_id, turn, array_to_string(list_concat(us[greatest(1, len(us) - 1):len(us)], [text]), ' ') AS augmented FROM u""")
def history_augment(spark, sf):
    return dialogue.augmented(table(spark, sf, "conversations")).select("conv_id", "turn", "augmented")


@register("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def history_cap(spark, sf):
    return dialogue.capped(table(spark, sf, "conversations"), 4).select("conv_id", "turn")


def _results(spark, sf):
    base = table(spark, sf, "embeddings").select(F.col("label").alias("question_id")).distinct()
    qs = base.withColumn("partial_mode", F.col("question_id") % 2 == 0)
    answers = base.select("question_id", F.lit(0).alias("variant_idx"), F.when(F.col("question_id") % 7 == 6, "").otherwise(F.concat(F.lit("answer "), "question_id")).alias("answer"))
    m = _metrics(spark, sf).where("question_id % 5 != 4").withColumns({c: F.when(F.col("question_id") % 3 != 1, F.col(c)) for c in ("token", "embedding", "judge")})
    checked = base.select(F.col("question_id").alias("answer_id"), F.array(F.lit("x")).alias("found"), F.array().cast("array<string>").alias("missing"), F.array(F.struct(F.lit("answer").alias("wrong"), F.lit("reply\nmore").alias("right"))).alias("corrections"))
    return pipeline.results(qs, answers, m, checked)


_STATUS = f"""WITH b AS (SELECT DISTINCT label AS q FROM embeddings), s AS (SELECT q, CASE WHEN q % 7 = 6 THEN 'no_rag_result' WHEN q % 5 = 4 OR q % 3 != 1 THEN 'hallucination_detected' WHEN q % 2 = 0 THEN 'partial_mode' ELSE 'success' END AS status FROM b)
SELECT q AS question_id, status, CASE status WHEN 'no_rag_result' THEN '{C.NO_RESULT}' WHEN 'hallucination_detected' THEN '{C.REFUSAL}' ELSE 'reply ' || q END AS final_answer FROM s"""


@register(_STATUS)
def pipeline_status(spark, sf):
    return _results(spark, sf).select("question_id", "status", "final_answer")


@register("""SELECT doc_id, lang AS query, CASE WHEN doc_id % 2 = 0 THEN 3 END::INT AS score, CASE WHEN doc_id % 3 != 0 THEN 0.5 END::DOUBLE AS median_f1, doc_id % 3 != 0 AS has_consistency, FALSE AS has_ner FROM documents""")
def result_json(spark, sf):
    d = table(spark, sf, "documents")
    body = pipeline.result_json(
        F.struct(F.col("lang").alias("query"), F.lit("success").alias("status")),
        {
            "specificity": F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit(3).alias("score"), F.lit(None).cast("string").alias("legal_issue"))),
            "consistency": F.when(F.col("doc_id") % 3 != 0, F.struct(F.lit(0.5).alias("median_f1"))),
            "ner_check": F.lit(None).cast("struct<is_stub:boolean>"),
        },
    )
    j = d.select("doc_id", body.alias("j"))
    at = lambda p: F.get_json_object("j", p)
    return j.select(
        "doc_id", at("$.query").alias("query"), at("$.specificity.score").cast("int").alias("score"), at("$.consistency.median_f1").cast("double").alias("median_f1"),
        F.array_contains(F.json_object_keys("j"), "consistency").alias("has_consistency"), F.array_contains(F.json_object_keys("j"), "ner_check").alias("has_ner"),
    )


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def ingest_filter(spark, sf):
    from .sources.http import supreme

    court = F.when(F.col("o_orderstatus") == "F", C.SUPREME_COURT).otherwise("other")
    return supreme(table(spark, sf, "orders").withColumn("법원명", court)).select("o_orderkey")


def _requests(spark, sf):
    t = table(spark, sf, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("만화로 "), "text")).when(F.col("turn") % 3 == 1, F.col("text")).otherwise("")
    r = F.struct(said.alias("utterance"), F.when(F.col("conv_id") % 2 == 0, F.lit("http://callback")).alias("callbackUrl"))
    return t.select("conv_id", "turn", reply.request(F.to_json(F.struct(r.alias("userRequest")))).alias("r"))


_SAID = "CASE turn % 3 WHEN 0 THEN '만화로 ' || text WHEN 1 THEN text ELSE '' END"


@register(f"SELECT conv_id, turn, {_SAID} AS utterance, CASE WHEN turn % 3 = 0 THEN 'image' ELSE 'text' END AS route, CASE WHEN turn % 3 = 0 THEN '{C.WAIT_COMIC}' ELSE '{C.WAIT_TEXT}' END AS wait FROM conversations")
def payload_route(spark, sf):
    u = F.col("r.utterance")
    return _requests(spark, sf).select("conv_id", "turn", u.alias("utterance"), reply.route(u).alias("route"), reply.wait_message(u).alias("wait"))


@register(f"SELECT conv_id, turn, CASE WHEN {_SAID} = '' THEN '{C.EMPTY_UTTERANCE}' ELSE left(translate({_SAID}, '*#', ''), 500) END AS reply FROM conversations")
def reply_text(spark, sf):
    u = F.col("r.utterance")
    return _requests(spark, sf).select("conv_id", "turn", reply.reply_text(u, text.without_markdown(u)).alias("reply"))


@register("SELECT conv_id, turn, 'https://image.pollinations.ai/prompt/' || role || '%20' || conv_id || '%2C%20x/y%3F' || '?width=800&height=400&nologo=true&seed=' || (('0x' || md5(conv_id::VARCHAR)[1:8])::BIGINT % 1000 + 1) AS url FROM conversations")
def image_url(spark, sf):
    p = F.concat("role", F.lit(" "), F.col("conv_id").cast("string"), F.lit(", x/y?"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.image_url(p, F.col("conv_id")).alias("url"))


#: Words of every command, some in other letters and with blanks, and what no command is.
_COMMANDS = [(f" {w.upper()}\n" if i % 2 else w, name) for name, words in C.COMMANDS.items() for i, w in enumerate(words)] + [("question", "ask"), (" \n", "empty"), ("helps", "ask")]


@register("SELECT conv_id, turn, [" + ", ".join(f"'{name}'" for _, name in _COMMANDS) + f"][(conv_id * 7 + turn) % {len(_COMMANDS)} + 1] AS command FROM conversations")
def session_command(spark, sf):
    said = F.get(F.array(*[F.lit(w) for w, _ in _COMMANDS]), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(_COMMANDS))).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", dialogue.command(said).alias("command"))


#: Rules of the large set: pairs of the longer words of documents, the first of them by their digests.
_MANY = 5000
_MANY_RULES = rf"""w AS (SELECT w, row_number() OVER (ORDER BY md5(w), w) - 1 AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) AS w FROM documents) QUALIFY n < {2 * _MANY}),
r AS (SELECT n // 2 AS i, list(w ORDER BY n) AS ws FROM w GROUP BY n // 2)"""


@register(f"WITH {_MANY_RULES}, h AS (SELECT doc_id, i FROM documents, r WHERE contains(text, ws[1]) OR contains(text, coalesce(ws[2], ws[1]))), e AS (SELECT doc_id, count(*) AS n, string_agg('rule ' || i, ' ' ORDER BY i) AS e FROM h GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n_rules, sha256(CASE WHEN n IS NULL THEN text ELSE trim(text || ' ' || e) END) AS query_sha256 FROM documents LEFT JOIN e USING (doc_id)")
def expand_query_thousands(spark, sf):
    """Five thousand rules over all documents."""
    d = table(spark, sf, "documents")
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("w")).distinct()
    listed = [r["w"] for r in words.orderBy(F.md5("w"), "w").limit(2 * _MANY).collect()]  # the size of the rule set
    made = [("|".join(listed[i : i + 2]), f"rule {i // 2}") for i in range(0, len(listed), 2)]
    q = d.select("doc_id", "text", rules.expand_query(F.col("text"), made).alias("q"))
    n = F.regexp_count(F.substr("q", F.length("text") + 1), F.lit("rule "))
    return q.select("doc_id", n.cast("long").alias("n_rules"), F.sha2("q", 256).alias("query_sha256"))


#: Names of a register of laws, of several words too.
_NAMES = ["형법", "근로기준법", "성폭력범죄의 처벌 등에 관한 특례법"]
_BY_NAME = "SELECT o_orderkey, i AS ord, CASE i WHEN 0 THEN '형법 제' || a || '조' WHEN 1 THEN '성폭력범죄의 처벌 등에 관한 특례법 제' || b || '조의2' WHEN 2 THEN '근로기준법 제' || a || '조' ELSE '근로기준법 제' || b || '조 제1항' END AS citation FROM (SELECT o_orderkey, o_orderkey % 400 AS a, o_orderkey * 3 % 400 AS b FROM orders), range(0, 4) t(i)"


def _by_name(spark, sf):
    n = lambda k: F.pmod(F.col("o_orderkey") * k, F.lit(400)).cast("string")
    body = F.concat(F.lit("「형법」 제"), n(1), F.lit("조와 군형법 제9조, 성폭력범죄의 처벌 등에 관한 특례법 제"), n(3), F.lit("조의2 및 근로기준법 제"), n(1), F.lit("조, 제"), n(3), F.lit("조 제1항"))
    return table(spark, sf, "orders").select("o_orderkey", body.alias("body"), law_names.cited(body, _NAMES).alias("c"))


@register(_BY_NAME)
def citation_names(spark, sf):
    """Quoted names, names of several words, and articles that share a name: the opt-in form of ``citation_extract``."""
    return _by_name(spark, sf).select("o_orderkey", F.posexplode("c").alias("ord", "x")).select("o_orderkey", F.col("ord").cast("long").alias("ord"), "x.citation")


@register("SELECT o_orderkey, '형법 제' || b || '조와 군형법 제9조, 성폭력범죄의 처벌 등에 관한 특례법 제' || b || '조의2 및 근로기준법 제' || a || '조, <>' AS answer FROM (SELECT o_orderkey, o_orderkey % 400 AS a, o_orderkey * 3 % 400 AS b FROM orders)")
def corrections_at_once(spark, sf):
    """The first citation takes the number of the last, and the last goes: neither sees what the other has put in."""
    b = F.regexp_extract(F.element_at("c", -1)["article"], r"제(\d+)", 1)
    span = lambda x, right: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), right.alias("right"))
    spans = F.array(span(F.element_at("c", -1), F.lit("<>\nmore")), span(F.get("c", F.lit(0)), F.concat(F.lit("형법 제"), b, F.lit("조"))))
    return _by_name(spark, sf).select("o_orderkey", law_names.corrected_at(F.col("body"), spans).alias("answer"))


@register("SELECT event_id FROM events WHERE event_id % 5 IN (1, 3)")
def specificity_set_aside(spark, sf):
    """Checks whose score is no number or null: what a run puts into the table of bad rows."""
    k = F.pmod("event_id", F.lit(5))
    body = F.when(k == 0, F.lit("broken")).when(k == 1, '{"score": "high"}').when(k == 2, '{"score": "4"}').when(k == 3, '{"score": null}').otherwise("{}")
    turns = table(spark, sf, "events").select(F.col("event_id").alias("session_id"), F.lit(0).alias("turn"), body.alias("reply"))
    return dialogue.set_aside(turns)[1].select(F.col("session_id").alias("event_id"))


@register("""WITH p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, text FROM documents),
x AS (SELECT source, string_agg('[출처 ' || n || '] [판결문] 선고  [] (유사도: 0.50)' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS t FROM p GROUP BY source)
SELECT source, CASE WHEN length(t) > 8000 THEN left(t, 8000) || chr(10) || chr(10) || '[... 컨텍스트 일부 생략 ...]' ELSE t END AS context FROM x""")
def context_bounded(spark, sf):
    """Contexts of all texts of a source: only what is printed is gathered."""
    hits = table(spark, sf, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("position"), F.lit("verdict").alias("source_type"), F.lit(0.5).alias("score"), "text",
        F.create_map(F.lit("court"), F.lit("")).alias("metadata"),
    )
    return context.contexts(hits).withColumnRenamed("query_id", "source")


def _replayed(spark, sf):
    folder, schema = f"{sf}/conversations.parquet", table(spark, sf, "conversations").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = spark.readStream.schema(schema)
    # Streams watch folders: a table that is one file is picked out of its own folder.
    if system.getFileStatus(path).isDirectory():
        return stream.parquet(folder)
    return stream.option("pathGlobFilter", "conversations.parquet").parquet(sf)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    from .streaming.front import drained

    return drained(stream, storage.fresh(stream.sparkSession, "stream"), mode)


@register("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'image' ELSE 'text' END AS route FROM conversations")
def stream_route(spark, sf):
    from .streaming.front import routed

    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("만화로 "), "text")).otherwise(F.col("text"))
    body = F.to_json(F.struct(F.struct(said.alias("utterance")).alias("userRequest")))
    s = _replayed(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), body.alias("body"))
    out = _drained(routed(s), "append")
    ids = F.split("request_id", "-")
    return out.select(F.get(ids, F.lit(0)).cast("long").alias("conv_id"), F.get(ids, F.lit(1)).cast("long").alias("turn"), "route")


@register("SELECT conv_id, count(*) AS n_seen, least(count(*), 4) AS n_kept, string_agg(role || ':' || text, '|' ORDER BY turn) FILTER (n <= 4) AS last FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) GROUP BY conv_id")
def stream_session(spark, sf):
    from .streaming.state import sessions

    out = _drained(sessions(_replayed(spark, sf), cap=4), "update").groupBy("conv_id").agg(F.max("n_seen").alias("n_seen"), F.max_by("kept", "n_seen").alias("kept"))
    last = F.array_join(F.transform("kept", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|")
    return out.select("conv_id", "n_seen", F.size("kept").cast("long").alias("n_kept"), last.alias("last"))


#: Sessions of the fixture begin an hour apart; the last one may still be open when the stream is read.
_CLOSED = _LOOP.replace(" FROM v WHERE", ", max(turn) AS last_turn, arg_max(e OR score >= 4, turn) AS done FROM v WHERE")


@register("WITH l AS (" + _CLOSED + ") SELECT session_id, question, checks, partial_mode, NOT done AND last_turn < 5 AS timed_out FROM l WHERE done OR last_turn = 5 OR session_id < (SELECT max(conv_id) FROM conversations)")
def stream_session_loop(spark, sf):
    from .streaming.state import session_loop

    body = F.when((F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 5 == 0), "").otherwise(F.col("text"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.least(F.col("turn"), F.lit(20)) * 60)
    s = _replayed(spark, sf).select(F.col("conv_id").alias("session_id"), "turn", body.alias("text"), ((F.col("conv_id") * 3 + F.col("turn")) % 6).alias("score"), at.alias("at"))
    return _drained(session_loop(s), "append").select("session_id", "question", "checks", "partial_mode", "timed_out")
