"""Context assembly and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, PROMPT, SEPARATOR, Config
from ..functions import text
from .retrieval import short_label

AUTHORITY = ["statute", "law_api", "verdict", "manual"]


def formatted(source: Column, meta, score: Column, body: Column, n: Column) -> Column:  # P7
    part = lambda k: F.coalesce(meta(k), F.lit(""))
    header = text.strip(
        F.concat(part("court"), F.lit(" "), part("decision_date"), F.lit(" 선고 "), part("case_number"), F.lit(" ["), part("section_type"), F.lit("]"))
    )
    head = F.when(source.isin("statute", "law_api", "manual"), short_label(source, meta)).otherwise(F.concat(F.lit("[판결문] "), header))
    return F.concat(F.lit("[출처 "), n.cast("string"), F.lit("] "), head, F.lit(" (유사도: "), printed(score), F.lit(")\n"), body)


def printed(score: Column) -> Column:
    """A score to two digits as C and Python print it: by its exact value, where ``format_string`` rounds its shortest decimals up."""
    return F.coalesce(F.call_function("format_number", score.cast("double"), F.lit("0.00")), F.lit("null"))


def contexts(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:  # A5, O2, P8
    """(query_id, context): sources in order of authority, joined, cut with a marker."""
    order = F.lit(len(AUTHORITY))
    for i, s in reversed(list(enumerate(AUTHORITY))):
        order = F.when(F.col("source_type") == s, i).otherwise(order)
    w = Window.partitionBy("query_id").orderBy(order, "position")
    rows = hits.withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_part", formatted(F.col("source_type"), lambda k: F.col("metadata")[k], F.col("score"), F.col("text"), F.col("_n")))
    # Only parts that begin inside the cut, or whose separator does, are gathered; one more character tells that there is a cut.
    before = F.sum(F.length("_part") + len(SEPARATOR)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= config.context_chars + len(SEPARATOR))
    rows = rows.withColumn("_part", F.left("_part", F.lit(config.context_chars + 1)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_part"))), lambda x: x["_part"])
    return rows.groupBy("query_id").agg(text.truncated(F.array_join(parts, SEPARATOR), config.context_chars).alias("context"))


def messages(system: Column, context: Column, query: Column) -> Column:  # P9
    user = F.concat(F.lit(PROMPT[0]), context, F.lit(PROMPT[1]), query, F.lit(PROMPT[2]))
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))
    )


def plain_messages(system: Column, query: Column) -> Column:  # L9
    """A prompt without references."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), query.alias("content")))
