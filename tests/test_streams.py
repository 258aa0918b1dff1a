"""Streams against their batch forms, over many triggers, restarts and replays."""

import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundwell import storage
from groundwell.operators import dialogue, reply
from groundwell.sources import http
from groundwell.streaming import front, state

DATA = "/root/testdata/sf0.001/conversations.parquet"


def streamed(spark, frames, folder):
    """Frames as the triggers of a stream."""
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{folder}/{i:03}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def checks(spark):
    t = spark.read.parquet(DATA).where("turn < 6")
    body = F.when((F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 5 == 0), "").otherwise(F.col("text"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60)
    return t.select(F.col("conv_id").alias("session_id"), "turn", body.alias("text"), ((F.col("conv_id") * 3 + F.col("turn")) % 6).alias("score"), at.alias("at"))


@pytest.mark.parametrize("order", ["by turn", "backwards", "one trigger"])
def test_the_loop_equals_its_batch_form(spark, tmp_path, order):
    c = checks(spark).cache()
    late = spark.createDataFrame([(-1, 0, "clock", 5, 1_700_000_000 + 9_000)], "session_id long, turn long, text string, score int, at long").withColumn("at", F.timestamp_seconds("at"))
    late = late.select(*[F.col(x).cast(t) for x, t in c.dtypes])
    parts = [c.where(F.col("turn") == i) for i in range(6)]
    parts = {"by turn": parts, "backwards": parts[::-1], "one trigger": [c]}[order]
    # Turns that come again change nothing; the last trigger moves the clock past every silence.
    s = streamed(spark, [*parts, parts[0], late], tmp_path / "in")
    got = front.drained(state.session_loop(s, delay="1 hour"), str(tmp_path / "out"), "append").drop("batch")
    own = sorted(tuple(r)[:4] for r in got.where("session_id >= 0").collect())
    assert own == sorted(tuple(r) for r in dialogue.session_loop(c).collect())
    silent = dialogue.session_loop(c).join(c.groupBy("session_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("text"), F.max_by("score", "turn").alias("score")), "session_id")
    assert {r["session_id"] for r in got.where("timed_out").collect()} <= {r["session_id"] for r in silent.where("partial_mode").collect()}


def test_late_turns_do_not_start_an_ended_session_anew(spark, tmp_path):
    rows = [[(1, 0, "a", 5, 0)], [(1, 0, "again", 1, 10), (1, 1, "b", 1, 20)], [(2, 0, "x", 1, 30)], [(3, 0, "clock", 4, 5000)], [(2, 1, "y", 5, 5001)], [(4, 0, "clock", 4, 9000)]]
    frames = [spark.createDataFrame([(s, t, x, n, 1_700_000_000 + at) for s, t, x, n, at in r], "session_id long, turn long, text string, score int, at long").withColumn("at", F.timestamp_seconds("at")) for r in rows]
    s = streamed(spark, frames, tmp_path / "in")
    got = front.drained(state.session_loop(s), str(tmp_path / "out"), "append").orderBy("session_id").collect()
    assert [(r["session_id"], r["question"], r["checks"], r["partial_mode"], r["timed_out"]) for r in got] == [
        (1, "a", 1, False, False), (2, "x", 1, True, True), (3, "clock", 1, False, False), (4, "clock", 1, False, False),
    ]


def test_histories_keep_the_last_messages(spark, tmp_path):
    t = spark.read.parquet(DATA).select("conv_id", "turn", "role", "text")
    many = spark.range(90).select(F.lit(10**6).cast("long").alias("conv_id"), F.col("id").cast(t.schema["turn"].dataType).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    t = t.unionByName(many).cache()
    for cap in (3, 20):
        s = streamed(spark, [t.where(F.pmod("turn", F.lit(4)) == i) for i in (2, 0, 3, 1)], tmp_path / f"in{cap}")
        got = front.drained(state.sessions(s, cap=cap), str(tmp_path / f"out{cap}"), "update")
        last = got.groupBy("conv_id").agg(F.max_by("kept", "n_seen").alias("kept"), F.max("n_seen").alias("n"))
        texts = {r["conv_id"]: [m["text"] for m in r["kept"]] for r in last.collect()}
        batch = dialogue.capped(t, cap).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]).alias("texts"))
        assert texts == {r["conv_id"]: r["texts"] for r in batch.collect()}
        assert last.agg(F.sum("n")).first()[0] == t.count()


def test_old_histories_are_forgotten_when_asked(spark, tmp_path):
    s = streamed(spark, [spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")], tmp_path / "in")
    out = []
    q = state.sessions(s, ttl_ms=3_600_000).writeStream.outputMode("update").foreachBatch(lambda rows, i: out.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(120):
        if out:
            break
        time.sleep(0.5)
    q.stop()
    assert [(r["conv_id"], [m["text"] for m in r["kept"]]) for r in out] == [(1, ["a"])]


def posted(url, payload, key):
    """Leaves a file a post in the folder that the address names."""
    import uuid

    if "broken" in payload:
        raise OSError("refused")
    if "slow" in payload:
        time.sleep(30)
    with open(f"{url}/{uuid.uuid4().hex}", "w") as f:
        f.write(json.dumps([key, payload]))


def replies(spark, heard, words):
    rows = [(f"r{i}", str(heard) if w != "nowhere" else None, json.dumps({"version": "2.0", "text": w})) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "request_id string, callback_url string, payload string")


def test_a_replayed_batch_sends_nothing_twice(spark, tmp_path):
    heard, log = tmp_path / "heard", str(tmp_path / "sent")
    heard.mkdir()
    rows = replies(spark, heard, ["a", "b", "broken", "nowhere", "slow"])
    send = front.deliver("tests.test_streams.posted", log, timeout=2.0)
    send(rows.unionAll(rows), 0)
    send(rows, 0)  # the batch again, after a failure of the driver
    send(rows.unionAll(replies(spark, heard, ["a", "b2"])), 1)
    got = [json.loads(p.read_text()) for p in heard.iterdir()]
    assert Counter(json.loads(p)["text"] for _, p in got) == {"a": 1, "b": 1, "b2": 1}
    assert all(json.loads(p)["idempotencyKey"] == k for k, p in got) and len({k for k, _ in got}) == 3
    kept = {(r["request_id"], r["sent"]): r["why"] for r in spark.read.parquet(log).collect()}
    assert kept[("r2", False)] == "OSError: refused" and kept[("r4", False)].startswith("TimeoutError") and ("r3", True) not in kept


def test_replies_are_delivered_by_a_stream(spark, tmp_path):
    heard, log = tmp_path / "heard", str(tmp_path / "sent")
    heard.mkdir()
    body = F.to_json(F.struct(F.struct(F.col("text").alias("utterance"), F.lit(str(heard)).alias("callbackUrl")).alias("userRequest")))
    t = spark.read.parquet(DATA)
    s = streamed(spark, [t.where("turn = 0"), t.where("turn > 0")], tmp_path / "in")
    routed = front.routed(s.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), body.alias("body")))
    made = routed.select("request_id", "callback_url", reply.reply(F.col("utterance"), F.concat(F.lit("to "), "utterance"), F.lit(None).cast("string")).alias("payload"))

    def run():
        q = made.writeStream.foreachBatch(front.deliver("tests.test_streams.posted", log)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    n = len(list(heard.iterdir()))
    run()
    assert n == len(list(heard.iterdir())) == t.count() == spark.read.parquet(log).where("sent").count()


def test_each_law_and_question_is_looked_up_once(spark, tmp_path):
    heard = tmp_path / "heard"
    heard.mkdir()
    q = spark.createDataFrame([(i, f"{heard}|question {i % 4}") for i in range(12)] + [(12, None)], "query_id long, query string")
    laws, articles = http.statutes(q, "tests.test_streams.register")
    for _ in range(2):
        assert laws.count() == 18 and articles.count() == 3  # the second question gets no answer in time
    calls = Counter(p.read_text() for p in heard.iterdir())
    assert calls == Counter([*(f"question {i}" for i in range(4)), "law 0", "law 1", "law 9"])


def register(kind, query):
    import uuid

    folder, _, word = (query["query"] if kind == "laws" else query["ID"]).partition("|")
    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
        f.write(word)
    if kind == "articles":
        return json.dumps({"법령": {"조문": {"조문단위": {"조번호": "1", "조문내용": "x"}}}})
    n = int(word.split()[-1])
    if n == 1:
        time.sleep(30)
    return json.dumps({"LawSearch": {"law": [{"법령ID": f"{folder}|law {m}", "법령명한글": f"law {m}"} for m in (9, n % 2, 7)][:3]}})


def test_calls_that_take_too_long_are_given_up():
    with pytest.raises(TimeoutError):
        http.within(0.05, time.sleep, 5)
    assert http.within(1, lambda x: x + 1, 2) == 3
    with pytest.raises(ZeroDivisionError):
        http.within(1, lambda: 1 / 0)


def test_tables_in_the_shared_folder(spark):
    t = storage.stored(spark.range(3))
    assert t.count() == 3 and storage.exists(spark, t.inputFiles()[0]) and not storage.exists(spark, storage.fresh(spark, "none"))
    with storage.scratch(spark):
        inner = storage.stored(spark.range(4))
        with storage.scratch(spark):
            deeper = storage.stored(inner)
            assert deeper.count() == 4
        assert inner.count() == 4 and not storage.exists(spark, deeper.inputFiles()[0])
        path = inner.inputFiles()[0]
    assert not storage.exists(spark, path) and t.count() == 3
