"""Hand-written cases of the question-answering operators."""

import json

import pytest
from pyspark.sql import functions as F

from groundwell.functions import scores, text
from groundwell.operators import citations, consistency, context, dialogue, reply, retrieval
from groundwell.plans import pipeline
from groundwell.sources import http


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("형법 제298조와 근로기준법 제76조의2 제1항 제3호, 형법 제298조", ["형법 제298조", "근로기준법 제76조의2 제1항 제3호"]),
        ("「형법」 제298조", []),
        ("성폭력범죄의 처벌 등에 관한 특례법 제14조의2", ["특례법 제14조의2"]),
        ("근로기준법 제23조 제26조 제28조", ["근로기준법 제23조"]),
        ("형법제298조", ["형법제298조"]),
        ("형법 제298조", ["형법 제298조"]),
    ],
)
def test_citations(spark, given, expected):
    assert one(spark, text.citations(F.lit(given))) == expected


@pytest.mark.parametrize(
    ("given", "expected"), [("(1)\n\n본문A\n본문B", "본문B"), ("결론 (4) 끝\n다음", "결론 다음"), ("결론\n(4)", "결론"), ("① 가\n　나 \x1c다", "가 나 다")]
)
def test_core(spark, given, expected):
    assert one(spark, text.core_text(F.lit(given))) == expected


@pytest.mark.parametrize(
    ("given", "expected"), [("0.8", 0.8), ("점수: 0.85", 0.85), ("8", 1.0), ("-0.5", 0.5), (".", 0.5), ("0.8.1", 0.5), ("없음", 0.5), ("０.９", 0.9), ("점수 ٠.٧", 0.7)]
)
def test_judged(spark, given, expected):
    assert one(spark, scores.judged(F.lit(given))) == expected


def test_expansion_keeps_rule_order_and_untouched_queries(spark):
    assert one(spark, text.expand_query(F.lit("증거 확보, 알바"))) == "증거 확보, 알바 근로기준법 최저임금법 증거 확보 방법 캡처 저장"
    assert one(spark, text.expand_query(F.lit(" nothing "))) == " nothing "


def test_fold_sees_earlier_results(spark):
    pairs = F.array(F.struct(F.lit("ab").alias("wrong"), F.lit("X\ncut").alias("right")), F.struct(F.lit("X").alias("wrong"), F.lit("YY").alias("right")))
    assert one(spark, citations.corrected(F.lit("abc ab"), pairs)) == "YYc YY"
    assert one(spark, citations.corrected(F.lit("same"), F.lit(None).cast("array<struct<wrong:string,right:string>>"))) == "same"


def test_ensemble(spark):
    rows = [(1, i, None, s, s) for i, s in enumerate((0.1, 0.4, 0.2, 0.9))] + [(2, 0, None, None, None)]
    p = spark.createDataFrame(rows, "question_id long, variant_idx int, token double, embedding double, judge double")
    got = {r["question_id"]: r for r in consistency.ensemble(p).collect()}
    assert got[1]["median_f1"] == 0.3 and got[1]["all_scores"] == [0.1, 0.4, 0.2, 0.9] and not got[1]["passed"]
    assert got[2]["median_f1"] == 1.0 and got[2]["passed"]


def test_questions_without_pairs_fail_the_gate(spark):
    q = spark.createDataFrame([(1,)], "question_id long")
    none = spark.createDataFrame([], "question_id long, median_f1 double, all_scores array<double>, passed boolean")
    r = consistency.all_questions(q, none).first()
    assert (r["median_f1"], r["all_scores"], r["passed"]) == (0.0, [], False)
    assert one(spark, pipeline.status(F.lit("apology"), F.lit(False), F.lit(True))) == "hallucination_detected"


@pytest.mark.parametrize(
    ("reply_text", "score", "bad"),
    [('{"score":"4"}', 4, False), ('{"score":3.7}', 3, False), ("{}", 3, False), ("oops", 3, False), ('{"score":null}', None, True), ('{"score":"x"}', None, True)],
)
def test_specificity(spark, reply_text, score, bad):
    r = one(spark, dialogue.specificity(F.lit(reply_text)))
    assert (r["score"], r["bad_score"]) == (score, bad)


def test_reask_rotation_needs_a_followup_of_middle_length(spark):
    assert one(spark, dialogue.reask_text(F.lit("x" * 20), F.lit("형사"), F.lit(1))) == "x" * 20
    assert one(spark, dialogue.reask_text(F.lit("x" * 16), F.lit("없는"), F.lit(3))) == dialogue.REASKS["불명확"][1]


def test_history_keeps_the_cap(spark):
    t = spark.createDataFrame([(1, i, "user", str(i)) for i in range(30)], "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in dialogue.capped(t).collect()) == list(range(10, 30))
    last = dialogue.augmented(t).where("turn = 29").first()["augmented"]
    assert last == "27 28 29"


def test_label_of_an_empty_verdict(spark):
    from groundwell.operators.context import formatted

    none = lambda k: F.lit(None).cast("string")
    assert one(spark, formatted(F.lit("verdict"), none, F.lit(0.5), F.lit("t"), F.lit(1))) == "[출처 1] [판결문] 선고  [] (유사도: 0.50)\nt"


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_retrieval_does_not_depend_on_partitions(spark, parts):
    rows = [(i, str(i), [float(i % 5), 1.0], f"text {i // 2}", ["statute", "manual", "verdict"][i % 3], {}) for i in range(60)]
    c = spark.createDataFrame(rows, "chunk_key long, doc_id string, embedding array<float>, text string, source_type string, metadata map<string,string>")
    q = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 1.0])], "query_id long, embedding array<float>")
    got = retrieval.retrieve(q, c.repartition(parts)).select("query_id", "position", "chunk_key").orderBy("query_id", "position").collect()
    base = retrieval.retrieve(q, c.coalesce(1)).select("query_id", "position", "chunk_key").orderBy("query_id", "position").collect()
    assert got == base and len(got) <= 18


def test_result_json_keeps_null_leaves_and_drops_null_sections(spark):
    body = pipeline.result_json(
        F.struct(F.lit("q").alias("query")), {"a": F.struct(F.lit(None).cast("string").alias("leaf")), "b": F.lit(None).cast("struct<x:int>")}
    )
    assert json.loads(one(spark, body)) == {"query": "q", "a": {"leaf": None}}


def test_replies(spark):
    r = one(spark, reply.reply(F.lit("그림 그려줘"), F.lit("a"), F.lit(None).cast("string")))
    assert json.loads(r)["template"]["outputs"][0]["simpleText"]["text"].startswith("🎨")
    r = one(spark, reply.reply(F.lit("질문"), F.lit("a" * 600), F.lit(None).cast("string")))
    assert len(json.loads(r)["template"]["outputs"][0]["simpleText"]["text"]) == 500
    assert json.loads(one(spark, reply.acknowledgement(F.lit("x"), F.lit("http://c"))))["useCallback"] is True


def fake_register(kind, query):
    pages = {1: {"PrecSearch": {"prec": [{"판례일련번호": "1"}, {"판례일련번호": "2"}, {"판례일련번호": "3"}]}}, 2: {"PrecSearch": {"prec": {"판례일련번호": "9"}}}, 3: {}}
    if kind == "list":
        return pages[query["page"]]
    if query["ID"] == "2":
        raise OSError("no answer")
    return {"PrecService": {"판례정보일련번호": query["ID"], "법원명": "대법원" if query["ID"] == "1" else "지방법원"}}


def test_precedents(spark, tmp_path):
    reader = http.PrecedentReader({"transport": "tests.test_operators.fake_register", "delay": "0"})
    rows = list(reader.read(reader.partitions()[0]))
    assert [r[0] for r in rows] == ["1", "3"]  # a failed detail is left out; a lone row reads as an empty page
    d = spark.createDataFrame(rows, http.PrecedentSource({}).schema())
    http.append_jsonl(http.supreme(d), str(tmp_path))
    http.append_jsonl(http.supreme(d), str(tmp_path))
    assert spark.read.json(str(tmp_path)).count() == 2


def test_lone_law_is_a_list():
    assert http.laws_of('{"LawSearch": {"law": {"법령ID": "1"}}}') == [{"법령ID": "1"}]
    assert http.articles_of('{"법령": {"조문": {"조문단위": {"조번호": "1"}}}}') == [{"조번호": "1"}]


def test_vectors_that_cannot_be_compared_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, None]), (5, [0.0, 1.0])]
    c = spark.createDataFrame(rows, "chunk_key long, embedding array<double>").withColumn("source_type", F.lit("statute"))
    q = c.select(F.col("chunk_key").alias("query_id"), "embedding")
    got = [(r["query_id"], r["chunk_key"]) for r in retrieval.knn(q, c, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 5), (5, 5), (5, 1)]


def test_history_stands_between_rules_and_question(spark):
    message = lambda r, c: F.struct(F.lit(r).alias("role"), F.lit(c).alias("content"))
    own = F.array(message("system", "s"), message("user", "q"))
    past = F.array(*[message("user", str(i)) for i in range(8)])
    assert [m["content"] for m in one(spark, dialogue.with_history(own, past))] == ["s", "2", "3", "4", "5", "6", "7", "q"]
    none = F.lit(None).cast("array<struct<role:string,content:string>>")
    assert [m["content"] for m in one(spark, dialogue.with_history(own, none))] == ["s", "q"]


def test_a_blank_reply_is_a_reply(spark):
    rows = [(1, 0, "ask", 1), (1, 1, "  ", 2), (1, 2, "more", 4), (2, 0, "ask", 1), (2, 1, "", 1), (2, 2, "late", 5)]
    got = {r["session_id"]: r for r in dialogue.session_loop(spark.createDataFrame(rows, "session_id long, turn long, text string, score int")).collect()}
    assert got[1]["question"] == "ask    more" and not got[1]["partial_mode"]
    assert got[2]["question"] == "ask" and got[2]["partial_mode"]


def test_empty_answers_make_no_pair(spark):
    rows = [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (1, 3, None), (1, 4, "  "), (1, 5, "\n"), (1, 6, "\u00a0\x1c"), (2, 0, ""), (2, 1, "c"), (3, 1, "d")]
    got = consistency.pairs(spark.createDataFrame(rows, "question_id long, variant_idx int, answer string")).collect()
    assert [(r["question_id"], r["variant_idx"], r["reference"], r["answer"]) for r in got] == [(1, 2, "a", "b")]


def test_pages_can_be_partitions(spark):
    spark.dataSource.register(http.PrecedentSource)
    options = {"transport": "tests.test_operators.fake_register", "delay": "0", "parallel": "true", "pages": "3"}
    got = spark.read.format("precedents").options(**options).load()
    assert got.rdd.getNumPartitions() == 3 and sorted(r[0] for r in got.collect()) == ["1", "3"]


def test_precedents_as_a_data_source(spark):
    spark.dataSource.register(http.PrecedentSource)
    got = spark.read.format("precedents").option("transport", "tests.test_operators.fake_register").option("delay", "0").load()
    assert sorted(r[0] for r in got.collect()) == ["1", "3"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "rank", "score", "source_type", "label", "preview"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scores_in_contexts_are_printed_by_their_exact_value(spark):
    scores_ = [i / 10000 for i in range(-10000, 10001, 5)] + [1234.565]
    d = spark.createDataFrame([(1, i, x, "t", "verdict", {"court": ""}) for i, x in enumerate([0.345, 0.125])], "query_id int, position int, score double, text string, source_type string, metadata map<string,string>")
    shown = context.contexts(d).first()["context"]
    assert "(유사도: 0.34)" in shown and "(유사도: 0.12)" in shown  # 0.345 lies below its decimals, 0.125 is a tie
    got = spark.createDataFrame([(x,) for x in scores_], "s double").select("s", context.printed(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in got] == [f"{r['s']:.2f}" for r in got]
