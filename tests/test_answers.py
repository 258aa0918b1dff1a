"""The answer table asks each prompt once; the chain reads it."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundwell import chain_queries, config, storage
from groundwell.functions import text
from groundwell.operators import consistency, context
from groundwell.plans import answers, pipeline
from groundwell.queries import chunks, table
from groundwell.sources import http

SMALL = "/root/testdata/sf0.001"


def counting_client():
    """Answers, and leaves a line a call in the folder that the first message names."""
    import os
    import uuid

    def ask(messages):
        folder = messages[0]["content"]
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(messages[-1]["content"])
        if os.path.exists(f"{folder}/down") and messages[-1]["content"].endswith("3"):
            raise OSError("down")
        return "said " + messages[-1]["content"]

    return ask


def calls(folder):
    return Counter(p.read_text() for p in folder.iterdir() if p.name != "down")


def prompts(spark, folder, n, word="ask"):
    m = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(str(folder))), ("user", F.concat(F.lit(f"{word} "), F.col("id").cast("string"))))])
    return spark.range(n).select(F.col("id").alias("question_id"), F.lit(0).alias("variant_idx"), m.alias("messages"))


def ask(p):
    return http.complete(p, "tests.test_answers.counting_client", retries=0, backoff=0.0)


def test_each_prompt_is_asked_once_also_after_a_restart(spark, tmp_path):
    heard, path = tmp_path / "heard", str(tmp_path / "answers")
    heard.mkdir()
    first = answers.answered(prompts(spark, heard, 30), ask, path, round_prompts=7)
    for _ in range(3):  # every reader reads the table
        assert {(r["question_id"], r["answer"]) for r in first.collect()} == {(i, f"said ask {i}") for i in range(30)}
    assert answers.answered(prompts(spark, heard, 40), ask, path, round_prompts=7).count() == 40
    assert calls(heard) == Counter({f"ask {i}": 1 for i in range(40)})
    # Another prompt for the same variant is another request; the old answer stays with the old prompt.
    other = answers.answered(prompts(spark, heard, 2, "again"), ask, path).collect()
    assert {r["answer"] for r in other} == {"said again 0", "said again 1"} and answers.known(spark, path).count() == 42


def test_what_was_answered_before_a_failure_is_kept(spark, tmp_path):
    heard, path = tmp_path / "heard", str(tmp_path / "answers")
    heard.mkdir()
    (heard / "down").touch()
    with pytest.raises(Exception, match="down"):
        answers.answered(prompts(spark, heard, 20).where("question_id NOT IN (13)"), ask, path, round_prompts=2)
    kept = {r["question_id"] for r in answers.known(spark, path).collect()}
    before = calls(heard)
    (heard / "down").unlink()
    assert answers.answered(prompts(spark, heard, 20), ask, path, round_prompts=2).count() == 20
    after = calls(heard)
    assert kept and all(after[f"ask {i}"] == before[f"ask {i}"] == 1 for i in kept)


def test_prompts_without_messages_and_repeated_ones(spark, tmp_path):
    heard, path = tmp_path / "heard", str(tmp_path / "answers")
    heard.mkdir()
    p = prompts(spark, heard, 3)
    none = p.withColumn("messages", F.when(F.col("question_id") < 2, F.col("messages")))
    assert answers.answered(none.unionAll(none), ask, path).count() == 2
    assert calls(heard) == Counter({"ask 0": 1, "ask 1": 1})
    assert answers.answered(none.where("false"), ask, str(tmp_path / "nothing")).count() == 0


def test_the_chain_asks_once_and_checks_citations_of_what_passed(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    own = chain_queries._models(spark, SMALL)

    def embed(texts):
        import uuid

        rows = storage.stored(texts)
        (seen / uuid.uuid4().hex).write_text(json.dumps([r["text"] for r in rows.collect()]))
        return own.embed(rows)

    heard = spark.sparkContext.accumulator(0)

    def complete(p):
        def count(batches):
            for b in batches:
                heard.add(len(b))
                yield b

        return own.complete(p.mapInArrow(count, p.schema))

    models = pipeline.Models(own.variants, embed, complete, own.metrics)
    laws = spark.createDataFrame([("근로기준법",)], "law_name string")
    r = pipeline.full(chain_queries._turns(spark, SMALL), chunks(spark, SMALL), models, laws, chain_queries.SYSTEMS, str(tmp_path / "answers"), chain_queries._statute_rows(spark, SMALL))
    rows = r.collect()
    assert len(rows) == 2 and heard.value == 11 * sum(x["context"] is not None for x in rows)
    passed = [x for x in rows if x["passed"]]
    embedded = [t for p in seen.iterdir() for t in json.loads(p.read_text()) if not t.startswith("question")]
    cited = {c for x in passed for c in (x["found"] or []) + (x["missing"] or [])}
    assert set(embedded) == cited and len(embedded) == len(cited)
    assert all(x["found"] is None for x in rows if not x["passed"])


def test_a_question_without_metrics_has_no_scores(spark):
    rows = [(1, 0, None, 0.5, None), (1, 1, 0.5, None, None), (2, 0, 0.5, 0.5, 0.5)]
    p = spark.createDataFrame(rows, "question_id long, variant_idx int, token double, embedding double, judge double")
    got = {r["question_id"]: r for r in consistency.ensemble(p).collect()}
    assert (got[1]["median_f1"], got[1]["all_scores"], got[1]["passed"]) == (1.0, [], True)
    assert (got[2]["all_scores"], got[2]["passed"]) == ([0.5], False)


@pytest.mark.parametrize("lengths", [[10] * 900, [7900, 50], [7970], [7971], [7972], [7973, 5], [7974, 5], [7980, 1], [9000, 3]])
def test_contexts_gather_only_what_they_print(spark, lengths):
    rows = [(1, i + 1, "verdict", 0.5, "x" * n, {"court": "c"}) for i, n in enumerate(lengths)]
    hits = spark.createDataFrame(rows, "query_id long, position int, source_type string, score double, text string, metadata map<string,string>")
    part = lambda i, n: f"[출처 {i + 1}] [판결문] c  선고  [] (유사도: 0.50)\n" + "x" * n
    whole = config.SEPARATOR.join(part(i, n) for i, n in enumerate(lengths))
    cut = whole[:8000] + config.CUT if len(whole) > 8000 else whole
    assert context.contexts(hits).first()["context"] == cut


def test_cores_are_what_scores_read(spark):
    p = spark.createDataFrame([(1, 1, "(1) 쟁점\n하나\n(4) 끝", "① 둘\n본 답변은 참고용")], "question_id long, variant_idx int, reference string, answer string")
    r = consistency.cores(p).first()
    assert (r["reference_core"], r["answer_core"], r["answer"]) == ("하나", "둘", "① 둘\n본 답변은 참고용")


def test_result_json_carries_context_messages_and_chunks(spark):
    body = chain_queries._full(spark, SMALL).transform(lambda r: r.select("status", pipeline.layout(r).alias("j")))
    for r in body.collect():
        j = json.loads(r["j"])
        assert j["specificity"]["missing_elements"] == ["a"]
        if r["status"] != "no_rag_result" and j["original_rag"]["context_text"]:
            rag = j["original_rag"]
            assert [m["role"] for m in rag["prompt_messages"]] == ["system", "user"] and rag["context_text"] in rag["prompt_messages"][1]["content"]
            assert rag["retrieved_chunks"] and set(rag["retrieved_chunks"][0]) == {"chunk_id", "text", "score", "source_type", "metadata"}


def test_questions_of_all_tables_are_embedded(spark):
    texts = table(spark, SMALL, "documents").limit(1).select(F.col("doc_id").alias("id"), F.lit("question 100 딥페이크").alias("text"))
    assert chain_queries._embed(spark, SMALL)(texts.withColumn("text", text.expand_query(F.col("text")))).count() == 1
