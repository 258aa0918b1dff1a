"""Large rule sets, law names, replacements in one pass, registers and images as data sources, counts."""

import json
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwell import chain_queries, config
from groundwell.functions import laws, rules, text
from groundwell.operators import dialogue
from groundwell.plans import pipeline
from groundwell.plans.counts import Counts
from groundwell.queries import chunks
from groundwell.sources import http

SMALL = "/root/testdata/sf0.001"
SPECIAL = "성폭력범죄의 처벌 등에 관한 특례법"


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        ("abc", {"abc"}), ("ab.*cde", {"cde"}), ("ab|cd.*efg", {"ab", "efg"}), ("(?:ab|c)de+", {"d"}), ("[ab]c", {"c"}), ("a?b", {"b"}), (".*", None), ("(ab)+", {"ab"}),
        ("(?i)abc", None), ("ab|.", None), (r"\bword\b", {"word"}), ("x{0,2}yz", {"yz"}), (r"\d+", None), ("(?=abc)d", {"d"}),
    ],
)
def test_literals_that_a_match_must_hold(pattern, expected):
    assert rules.literals(pattern) == expected


def test_candidates_lose_no_match():
    rng = random.Random(7)
    atoms = ["a", "b", "ab", "ba", "c", ".", "[ab]", "(?:a|bc)", "(ab)?", "c*", "b+", "^", "$", r"\s", "a{2}", "(?:b|.)c"]
    made = []
    for i in range(800):
        p = "|".join("".join(rng.choice(atoms) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4)))
        made.append((p, f"e{i}"))
    own = rules.Rules(made)
    for _ in range(400):
        t = "".join(rng.choice("abc \n") for _ in range(rng.randrange(12)))
        assert own.matching(t) == [i for i, (p, _) in enumerate(made) if re.search(p, t)]


def test_both_forms_of_expansion_agree(spark):
    said = ["증거 확보, 알바", " nothing ", "", None, "온라인에서 성희롱을", "온라인\r성희롱", "온라인\n성희롱", "딥페이크 카메라 수당 임금을 체불"]
    d = spark.createDataFrame([(x,) for x in said], "q string")
    got = d.select(text.expand_query(F.col("q")).alias("a"), rules.expand_query(F.col("q"), config.EXPANSIONS).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_cost_hardly_grows_with_the_rules():
    words = [f"word{i}x" for i in range(50_000)]
    few, many = rules.Rules([(w, w) for w in words[:50]]), rules.Rules([(w, w) for w in words])
    t = " ".join(words[::1000])
    assert len(many.candidates(t)) == 50 and len(few.candidates(t)) == 1 and not many.compiled
    many.matching(t)
    assert len(many.compiled) == 50


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("「형법」 제298조", ["형법 제298조"]),
        ("“형법” 제1조, 『근로기준법』제2조의3", ["형법 제1조", "근로기준법 제2조의3"]),
        (f"{SPECIAL} 제14조의2", [f"{SPECIAL} 제14조의2"]),
        ("근로기준법 제23조 제26조 제28조", ["근로기준법 제23조", "근로기준법 제26조", "근로기준법 제28조"]),
        ("형법 제298조와 근로기준법 제76조의2 제1항 제3호, 형법 제298조", ["형법 제298조", "근로기준법 제76조의2 제1항 제3호", "형법 제298조"]),
        ("근로기준법 제1조, 제2조 제3항 및 제4조", ["근로기준법 제1조", "근로기준법 제2조 제3항", "근로기준법 제4조"]),
        ("군형법 제1조, 형법과 제2조, 형법", []),
        ("형법 시행령 제3조, 형법 제4조", ["형법 시행령 제3조", "형법 제4조"]),
        ("", []),
        (None, None),
    ],
)
def test_citations_by_name(spark, given, expected):
    d = spark.createDataFrame([(given,)], "t string").select("t", laws.cited(F.col("t"), ["형법", "형법 시행령", "근로기준법", SPECIAL]).alias("c"))
    r = d.first()
    assert r["c"] == expected if expected is None else [x["citation"] for x in r["c"]] == expected
    for x in r["c"] or ():
        part = given[x["start"] : x["stop"]]
        assert part.endswith(x["article"][-1]) and (x["law"] in part or part.startswith("제"))


def test_a_quoted_name_goes_with_its_quotes(spark):
    d = spark.createDataFrame([("또 「형법」 제1조!",)], "t string").withColumn("c", laws.cited(F.col("t"), ["형법"]))
    spans = F.transform("c", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit("형법 제2조").alias("right")))
    assert d.select(laws.corrected_at(F.col("t"), spans).alias("x")).first()["x"] == "또 형법 제2조!"


def test_spans_are_replaced_at_once(spark):
    kind = "t string, s array<struct<start:int,stop:int,right:string>>"
    rows = [
        ("abcdef", [(4, 5, "Y\nmore"), (0, 2, "X")]), ("abcdef", [(0, 4, "X"), (1, 2, "no"), (4, 6, "")]), ("漢字🙂é", [(2, 3, "!")]), ("same", []), ("same", None), (None, [(0, 1, "x")]),
        ("abc", [(0, 1, None), (1, 2, "B")]), ("abc", [(0, 1, "long"), (0, 3, "all")]),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(laws.corrected_at(F.col("t"), F.col("s"))).collect()]
    assert got == ["XcdYf", "X", "漢字!é", "same", "same", None, "aBc", "all"]


def test_pairs_are_replaced_in_one_pass(spark):
    kind = "t string, p array<struct<wrong:string,right:string>>"
    rows = [("abc ab", [("ab", "X\ncut"), ("X", "YY")]), ("형법 제1조 형법 제12조", [("형법 제1조", "가"), ("형법 제12조", "나")]), ("a", None), (None, [("a", "b")]), ("a.a", [(".", "a"), ("a", ".")]), ("ab", [("a", "1"), ("a", "2"), ("", "3"), ("b", None)])]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(laws.corrected_once(F.col("t"), F.col("p"))).collect()]
    assert got == ["Xc X", "가 나", "a", None, ".a.", "1b"]


@pytest.fixture
def pushed(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in (http.LawSource, http.ArticleSource, http.ImageSink):
        spark.dataSource.register(s)
    yield spark
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def answers(kind, query):
    """A register that leaves a file a question in the folder that the question names."""
    import uuid

    folder, _, word = (query["query"] if kind == "laws" else query["ID"]).partition("|")
    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
        f.write(word)
    if word.endswith("3"):
        raise OSError("down")
    if kind == "articles":
        return json.dumps({"법령": {"조문": {"조문단위": [{"조번호": "1", "조문내용": word}, {"조번호": "2", "조문내용": word}]}}})
    return json.dumps({"LawSearch": {"law": {"법령ID": word, "법령명한글": f"law {word}"}}})


def test_registers_are_asked_what_filters_name(pushed, tmp_path):
    heard = tmp_path / "heard"
    heard.mkdir()
    keys = [f"{heard}|{i}" for i in range(7)]
    read = pushed.read.format("laws").option("transport", "tests.test_rules_and_sources.answers").option("block", 2).load()
    got = read.where(F.col("query").isin(*keys, keys[0]))
    assert got.rdd.getNumPartitions() == 4
    heard_before = len(list(heard.iterdir()))
    assert sorted(r["law_id"] for r in got.collect()) == ["0", "1", "2", "4", "5", "6"]
    assert Counter(p.read_text() for p in heard.iterdir()) == Counter(str(i) for i in range(7)) and not heard_before
    articles = pushed.read.format("articles").option("transport", "tests.test_rules_and_sources.answers").load()
    assert articles.where(F.col("law_id") == keys[1]).where("no = '2'").select("content").collect()[0][0] == "1"
    other = read.where(F.col("query").isin(keys[4], keys[5])).where(F.col("query") != keys[5])
    assert [r["law_id"] for r in other.collect()] == ["4"]
    with pytest.raises(Exception, match="filter by query"):
        pushed.read.format("laws").option("transport", "tests.test_rules_and_sources.answers").load().collect()


def test_each_request_has_one_image(pushed, tmp_path):
    path = tmp_path / "images"
    rows = [(f"r/{i}", bytes([i]) * 10) for i in range(6)]
    d = pushed.createDataFrame(rows, "request_id string, image binary").repartition(3)
    for _ in range(2):  # the same requests again, as tasks that are tried again
        d.write.format("images").option("path", path.as_uri()).mode("append").save()
    files = {p.name: p.read_bytes() for p in path.iterdir() if p.is_file()}
    assert files.pop("_SUCCESS") == b"" and files == {f"r%2F{i}.png": bytes([i]) * 10 for i in range(6)}
    assert not (path / "_attempts").exists()


def test_failed_writes_leave_no_half_files(pushed, tmp_path):
    path = tmp_path / "images"
    d = pushed.createDataFrame([("a", b"1")], "request_id string, image binary").unionAll(pushed.range(1).select(F.lit("b"), F.raise_error(F.lit("stop")).cast("binary")))
    with pytest.raises(Exception, match="stop"):
        d.coalesce(1).write.format("images").option("path", path.as_uri()).mode("append").save()
    assert not (path / "_SUCCESS").exists() and not (path / "_attempts").exists()


def test_appended_lines_come_once_when_asked(spark, tmp_path):
    path, key = str(tmp_path / "lines"), config.PRECEDENT_FIELDS[0]
    d = spark.createDataFrame([(str(i % 4), f"판례 {i % 4}") for i in range(8)], f"`{key}` string, `사건명` string")
    for _ in range(3):
        http.append_jsonl(d, path, distinct=True)
    http.append_jsonl(d.limit(0).unionAll(spark.createDataFrame([("9", "x")], d.schema)), path, distinct=True)
    assert sorted(r[key] for r in spark.read.json(path).collect()) == ["0", "1", "2", "3", "9"]
    http.append_jsonl(d, path)
    assert spark.read.json(path).count() == 13


def test_sessions_with_unreadable_scores_are_set_aside(spark, tmp_path):
    t = chain_queries._turns(spark, SMALL)
    odd = spark.createDataFrame([(7, 0, "q", '{"score": 5}'), (7, 1, "q", '{"score": "high"}'), (8, 0, "q", '{"score": null}')], "session_id long, turn int, text string, reply string")
    sound, bad = dialogue.set_aside(t.unionByName(odd))
    assert {r["session_id"] for r in bad.collect()} == {7, 8} and sound.count() == t.count()
    counts, path = Counts(), str(tmp_path / "bad")
    laws_ = spark.createDataFrame([("근로기준법",)], "law_name string")
    r = pipeline.full(t.unionByName(odd), chunks(spark, SMALL), chain_queries._models(spark, SMALL), laws_, chain_queries.SYSTEMS, str(tmp_path / "answers"), chain_queries._statute_rows(spark, SMALL), bad=path, counts=counts)
    assert r.count() == 2 and sorted(x["reply"] for x in spark.read.parquet(path).collect()) == ['{"score": "high"}', '{"score": null}']
    seen = counts.get()
    assert seen["bad turns"]["rows"] == 2 and seen["questions"]["rows"] == 2 and seen["answers"]["rows"] == seen["prompts"]["rows"] == 22


def test_memory_of_expansion_does_not_follow_the_batch(spark):
    own = rules.Rules([("word1|word2", "one"), ("other", "two")])
    texts = pa.array([f"word{i % 7} " + "some text " * 200 for i in range(8000)] + [None])
    tracemalloc.start()
    n = sum(len(x) for x in rules.expansions(iter([texts]), own))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 4 << 20  # the strings of the batch are 16 MB, and those that come of them too
    d = spark.range(3000).selectExpr("id", "'word' || (id % 7) AS q", "'other' || id AS r").repartition(2)
    got = d.select("id", *[rules.expand_query(F.col(c), own.rules).alias(c) for c in ("q", "r")]).collect()
    assert sorted(tuple(r) for r in got) == [(i, f"word{i % 7}" + (" one" if i % 7 in (1, 2) else ""), f"other{i} two") for i in range(3000)]
