"""The chat front end as a stream: parse, route, deliver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..operators import reply
from ..sources.http import call, within


def routed(requests: DataFrame) -> DataFrame:  # S11, P17, P27
    """request_id, utterance, callback_url, route, ack from (request_id, body)."""
    r = requests.select("request_id", reply.request(F.col("body")).alias("r")).select("request_id", "r.*")
    return r.select("*", reply.route(F.col("utterance")).alias("route"), reply.acknowledgement(F.col("utterance"), F.col("callback_url")).alias("ack"))


def drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """All that a stream gives until its source is read, as a table in ``folder``, which all machines share.

    Each batch is a folder of its own, written whole again if it is repeated after a failure.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


SENT = "request_id string, key string, sent boolean, why string"


def deliver(post: str, table: str, timeout: float = 30.0) -> Callable[[DataFrame, int], None]:  # S12
    """A foreachBatch sink that posts replies (request_id, callback_url, payload) from the tasks.

    ``post`` names a callable of url, payload and key. The key is a digest of request and payload; the payload
    carries it too (``idempotencyKey``), so that receivers can tell repeats. What was posted is kept in
    ``table``, failures with their reason: a batch that is repeated sends nothing that the table holds, so a
    reply goes out once, and what fails is dropped, not tried again. Only a crash between the posts
    of a batch and their record sends these again, under the same keys. Rows without an address are left
    out; repeated rows are sent once.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = call(post)
        for batch in batches:
            why: list[str | None] = []
            for url, payload, key in zip(*(batch.column(i).to_pylist() for i in (2, 3, 1)), strict=True):
                try:
                    within(timeout, to, url, payload, key)
                    why.append(None)
                except Exception as e:
                    why.append(f"{type(e).__name__}: {e}")
            sent = pa.array([w is None for w in why], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sent, pa.array(why, pa.string())], ["request_id", "key", "sent", "why"])

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        own = rows.where("callback_url IS NOT NULL").select(F.col("request_id").cast("string").alias("request_id"), "callback_url", "payload")
        keyed = own.withColumn("key", F.sha2(F.concat_ws("\x00", "request_id", "payload"), 256)).dropDuplicates(["key"])
        if storage.exists(spark, table):
            keyed = keyed.join(spark.read.schema(SENT).parquet(table).select("key"), "key", "left_anti")
        named = keyed.select("request_id", "key", "callback_url", reply.with_key(F.col("payload"), F.col("key")).alias("payload"))
        named.mapInArrow(send, SENT).write.mode("append").parquet(table)

    return batch
