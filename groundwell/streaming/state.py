"""Conversations as keyed state: the re-asking loop and the capped history (stateful processors on RocksDB)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..config import DEFAULT, Config

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds of silence after which a session ends as partial, and for which an ended one is remembered.
#: Neither is part of the batch loop, which takes a session's last turn for its end.
SILENCE_MS = 30 * 60 * 1000
REMEMBERED_MS = 24 * 60 * 60 * 1000


def on_rocksdb(spark: SparkSession) -> None:
    """State that is larger than memory; processors of this module need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Loop(StatefulProcessor):
    """One session: what was asked so far, turns that came before their time, and a timer."""

    def __init__(self, config: Config, silence_ms: int, remembered_ms: int) -> None:
        self.pass_score, self.last_turn = config.specificity_pass, config.max_reasks
        self.silence_ms, self.remembered_ms = silence_ms, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        asked = [("question", StringType()), ("checks", LongType()), ("next", LongType()), ("last", LongType()), ("timer", LongType()), ("ended", BooleanType())]
        turn = [("text", StringType()), ("score", IntegerType()), ("at", LongType())]
        self.asked = handle.getValueState("asked", StructType([StructField(n, t) for n, t in asked]))
        self.early = handle.getMapState("early", StructType([StructField("turn", LongType())]), StructType([StructField(n, t) for n, t in turn]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        question, checks, turn, last, timer, ended = self.asked.get() if self.asked.exists() else (None, 0, 0, 0, 0, False)
        if ended:
            for _ in rows:
                pass
            return
        for r in rows:
            at = int(r["at"].timestamp() * 1000)
            last = max(last, at) if not checks else last
            if turn <= r["turn"] <= self.last_turn and not self.early.containsKey((r["turn"],)):
                self.early.updateValue((r["turn"],), (r["text"], r["score"], at))
        partial = silent = False
        while not ended and self.early.containsKey((turn,)):
            text, score, at = self.early.getValue((turn,))
            self.early.removeKey((turn,))
            if turn and at > last + self.silence_ms:
                ended = partial = silent = True
            elif turn and not text:  # no reply
                ended = partial = True
            else:
                question = text if question is None else question if text is None else f"{question} {text}"
                enough = score is not None and score >= self.pass_score
                ended, partial = enough or turn == self.last_turn, not enough
                checks, last, turn = checks + 1, max(last, at) if turn else at, turn + 1
        if ended:
            self.early.clear()
            yield Row(session_id=key[0], question=question or "", checks=checks, partial_mode=partial, timed_out=silent)
        due = last + (self.remembered_ms if ended else self.silence_ms)
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.asked.update((question, checks, turn, last, due, ended))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        question, checks, turn, last, _, ended = self.asked.get()
        self.early.clear()
        if ended:
            self.asked.clear()
            return
        yield Row(session_id=key[0], question=question or "", checks=checks, partial_mode=True, timed_out=True)
        due = timerValues.getCurrentWatermarkInMs() + self.remembered_ms
        self.handle.registerTimer(due)
        self.asked.update((question, checks, turn, last, due, True))

    def close(self) -> None:
        pass


def session_loop(turns: DataFrame, delay: str = "0 seconds", silence_ms: int = SILENCE_MS, remembered_ms: int = REMEMBERED_MS, config: Config = DEFAULT) -> DataFrame:  # C1
    """session_id, question, checks, partial_mode, timed_out: ``dialogue.session_loop`` as a stream.

    turns: session_id, turn (from 0, without gaps), text, score, at (event time). A session's row comes once
    it ends: with a sufficient check, without a reply (null or ''), or with the last re-ask. Turns may come in
    any order and more than once; later ones wait for those before them. A session whose next turn is
    over ``silence_ms`` of event time away, or missing for so long, ends as partial and timed out, which
    the batch loop has not. Ended sessions are remembered for a while, so that late turns do not start them anew.
    """
    on_rocksdb(turns.sparkSession)
    rows = turns.selectExpr("session_id", "CAST(turn AS BIGINT) AS turn", "text", "CAST(score AS INT) AS score", "at").withWatermark("at", delay)
    return rows.groupBy("session_id").transformWithState(
        Loop(config, silence_ms, remembered_ms), "session_id long, question string, checks long, partial_mode boolean, timed_out boolean", "Append", "EventTime"
    )


class Last(StatefulProcessor):
    """One conversation: its last messages, oldest first, and how many there were."""

    def __init__(self, cap: int, ttl_ms: int | None) -> None:
        self.cap, self.ttl_ms = cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())]
        self.messages = handle.getListState("messages", StructType(fields), ttlDurationMs=self.ttl_ms)
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]), ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        kept, n = [tuple(m) for m in self.messages.get()], self.seen.get()[0] if self.seen.exists() else 0
        for r in rows:
            n += 1
            kept.append((r["turn"], r["role"], r["text"]))
            if len(kept) > 4 * self.cap:  # a trigger may bring any number of turns
                kept = sorted(kept, key=lambda m: m[0])[-self.cap :]
        kept = sorted(kept, key=lambda m: m[0])[-self.cap :]
        self.messages.put(kept)
        self.seen.update((n,))
        yield Row(conv_id=key[0], n_seen=n, kept=[Row(turn=t, role=r, text=x) for t, r, x in kept])

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, cap: int = DEFAULT.history_cap, ttl_ms: int | None = None) -> DataFrame:  # W3, C12
    """conv_id, n_seen and kept (turn, role, text of the last messages by turn) after each trigger.

    turns: conv_id, turn, role, text. State holds ``cap`` messages a conversation. With ``ttl_ms`` a
    conversation that is silent for so long (by the clock) is forgotten; such a stream runs
    until it is stopped, as state may run out at any time.
    """
    on_rocksdb(turns.sparkSession)
    rows = turns.selectExpr("conv_id", "CAST(turn AS BIGINT) AS turn", "role", "text")
    return rows.groupBy("conv_id").transformWithState(
        Last(cap, ttl_ms), "conv_id long, n_seen long, kept array<struct<turn:long,role:string,text:string>>", "Update", "ProcessingTime" if ttl_ms else "None"
    )
