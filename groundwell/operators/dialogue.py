"""Specificity gate, re-asking, histories, commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import COMMANDS, DEFAULT, REASKS, UNCLEAR, Config
from ..functions import text


def reask(category: Column, n: Column, templates: dict[str, list[str]] | None = None) -> Column:  # P15
    templates = REASKS if templates is None else templates
    pick = lambda ts: F.get(F.array(*[F.lit(t) for t in ts]), F.pmod(n, F.lit(len(ts))).cast("int"))
    out = pick(templates[UNCLEAR])
    for name, ts in templates.items():
        out = F.when(category == name, pick(ts)).otherwise(out)
    return out


def specificity(reply: Column, config: Config = DEFAULT) -> Column:  # P14
    """Struct of the parsed reply. Unreadable replies take the defaults; a score that is no number,
    or is null, is marked ``bad_score`` for the caller to set aside."""
    v = F.try_parse_json(reply)
    plain = F.schema_of_variant(v).startswith("OBJECT")
    field = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    ok = v.isNotNull() & plain
    absent = F.get_json_object(reply, "$.score").isNull() & ~F.array_contains(F.coalesce(F.json_object_keys(reply), F.array().cast("array<string>")), "score")
    score = F.when(~ok | absent, F.lit(3)).otherwise(field("score", "int"))
    category = F.coalesce(F.when(ok, field("legal_category", "string")), F.lit(UNCLEAR))
    followup = F.when(ok, field("followup_question", "string"))
    followup = F.when(F.length(followup) >= config.followup_parse_chars, followup).otherwise(reask(category, F.lit(0)))
    missing = F.coalesce(F.when(ok, field("missing_elements", "array<string>")), F.array().cast("array<string>"))
    return F.struct(
        score.alias("score"),
        F.coalesce(F.when(ok, F.get_json_object(reply, "$.entities")), F.lit("{}")).alias("entities"),
        category.alias("legal_category"),
        F.when(ok, field("legal_issue", "string")).alias("legal_issue"),
        missing.alias("missing_elements"),
        followup.alias("followup_question"),
        F.coalesce(score >= config.specificity_pass, F.lit(False)).alias("is_sufficient"),
        (ok & ~absent & score.isNull()).alias("bad_score"),
    )


def set_aside(turns: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:  # P14
    """(sound, bad): turns (session_id, turn, reply) of sessions whose checks all have scores, and the turns without one.

    A score that is no number, or null, is an error of the model. Its session is not answered by guess:
    it goes as a whole, and the bad rows come with what was replied.
    """
    bad = turns.where(specificity(F.col("reply"), config)["bad_score"])
    ids = bad.select(F.col("session_id").alias("_bad")).distinct()
    return turns.join(ids, F.col("session_id").eqNullSafe(F.col("_bad")), "left_anti"), bad


def reask_text(followup: Column, category: Column, n: Column, config: Config = DEFAULT) -> Column:  # C2
    return F.when(F.length(followup) >= config.followup_loop_chars, followup).otherwise(reask(category, n))


def variants(reply: Column, n: int = DEFAULT.variants) -> Column:  # P16
    """Questions of a reply: the list itself, its key ``questions``, or its first value."""
    listed = lambda x: F.from_json(x, "array<string>")
    first = F.get(F.map_values(F.from_json(reply, "map<string,string>")), F.lit(0))
    raw = (
        F.when(F.ltrim(reply).startswith("["), listed(reply))
        .when(F.get_json_object(reply, "$.questions").startswith("["), listed(F.get_json_object(reply, "$.questions")))
        .when(first.startswith("["), listed(first))
    )
    clean = F.filter(F.transform(raw, text.strip), lambda s: s != "")
    return F.slice(F.coalesce(clean, F.array().cast("array<string>")), 1, n)


def session_loop(checks: DataFrame, config: Config = DEFAULT) -> DataFrame:  # C1
    """session_id, question, checks, partial_mode.

    checks: session_id, turn (0: the question itself), text (question or reply), score of the check
    that follows it. The first sufficient check ends the loop; no reply (null or ''), or the last
    re-ask, ends it as partial. A reply of blanks is a reply.
    """
    w = Window.partitionBy("session_id").orderBy("turn")
    c = checks.where(F.col("turn") <= config.max_reasks)
    c = c.withColumn("_empty", (F.col("turn") > 0) & (F.coalesce("text", F.lit("")) == ""))
    done = ((F.col("score") >= config.specificity_pass) | F.col("_empty")).cast("int")
    c = c.withColumn("_ended", F.coalesce(F.sum(done).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.where("_ended = 0")
    used = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_empty"), F.struct("turn", "text")))), lambda x: x["text"])
    last = F.max_by(F.struct((F.col("score") >= config.specificity_pass).alias("ok"), F.col("_empty").alias("empty")), "turn")
    out = c.groupBy("session_id").agg(F.array_join(used, " ").alias("question"), F.sum((~F.col("_empty")).cast("int")).cast("long").alias("checks"), last.alias("_l"))
    return out.select("session_id", "question", "checks", (F.col("_l.empty") | ~F.coalesce("_l.ok", F.lit(False))).alias("partial_mode"))


def augmented(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:  # C10, W2
    """Adds ``augmented``: the last user texts among the turns before, then the text itself."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-config.history_scan, -1)
    users = F.transform(F.filter(F.collect_list(F.struct("role", "text")).over(w), lambda m: m["role"] == "user"), lambda m: m["text"])
    k = config.history_user_turns
    tail = F.when(F.size(users) > k, F.slice(users, F.lit(-k), F.lit(k))).otherwise(users)
    return turns.withColumn("augmented", F.concat_ws(" ", tail, "text"))


def with_history(messages: Column, history: Column, config: Config = DEFAULT) -> Column:  # C10
    """The last messages of a history between the system message and the question."""
    n = config.history_prompt
    tail = F.when(F.size(history) > n, F.slice(history, F.lit(-n), F.lit(n))).otherwise(history)
    none = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.slice(messages, 1, 1), F.coalesce(tail, none), F.slice(messages, F.lit(2), F.size(messages)))


def capped(turns: DataFrame, cap: int = DEFAULT.history_cap) -> DataFrame:  # W3
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_nth", nth).where(F.col("_nth") <= cap).drop("_nth")


def command(x: Column) -> Column:  # P24
    out = F.lit("ask")
    word = F.lower(text.strip(x))
    for name, words in reversed(COMMANDS.items()):
        out = F.when(word.isin(words), F.lit(name)).otherwise(out)
    return F.when(word == "", F.lit("empty")).otherwise(out)
