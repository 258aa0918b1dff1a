"""Three-way merge of two branches of a table of texts, as a sequence CRDT with tombstones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed, private_names

#: What a register of a line or of a gap comes to.
SAME, CLEAN, EDIT_EDIT, EDIT_DELETE, INSERT_INSERT = range(5)

_EDIT = "struct<text:string>"
_UNIT = f"struct<edit:{_EDIT},gap:string>"


def edit(text: Column) -> Column:
    """A register that holds a new text; a null text is a tombstone."""
    return F.struct(text.alias("text"))


def untouched(kind: str = _EDIT) -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Edits:
    """What a branch does to a table, as expressions.

    dropped: of the id, whether the row goes. column: of id, name and value, the new value. lines: of id
    and lines (an array), an array of the same length that holds, for each line, null or a struct of
    ``edit`` (null: the line stays; a null text: it is dropped) and ``gap`` (null, or what is inserted after
    it). head: of id and lines, what is inserted before the first line, or null. added: rows that the branch
    adds (id, text and the columns).
    """

    dropped: Callable[[Column], Column]
    column: Callable[[Column, str, Column], Column]
    lines: Callable[[Column, Column], Column]
    head: Callable[[Column, Column], Column] | None = None
    added: DataFrame | None = None


def unique_rows(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text and a column each, nulls as '', one row an id: of rows with one id that of the smallest values."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_c_{c}") for c in columns],
    )
    again = checkpointed(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_id").alias("_again")))
    if again.isEmpty():
        return rows
    repeated = F.col("_id").eqNullSafe(F.col("_again"))
    one = rows.join(again, repeated, "left_semi").groupBy("_id").agg(F.min(F.struct("_text", *[f"_c_{c}" for c in columns])).alias("_r"))
    return rows.join(again, repeated, "left_anti").unionByName(one.select("_id", "_r.*"))


def replica(rows: DataFrame, edits: Edits, columns: tuple[str, ...]) -> DataFrame:
    """_id and _state of every row: what a branch holds beside the base.

    Lines are named by their place in the base, for good: a dropped line keeps its register as a
    tombstone, and insertions hang on the line before them. Columns whose new value is the old one are
    untouched. A row that is dropped, or left as it is, holds no registers.
    """
    values = [(c, F.col(f"_c_{c}"), edits.column(F.col("_id"), c, F.col(f"_c_{c}"))) for c in columns]
    of_lines = rows.select("*", F.split("_text", "\n", -1).alias("_base_lines"))
    r = of_lines.select(
        "_id",
        edits.dropped(F.col("_id")).alias("_dropped"),
        F.struct(*[F.when(new != old, edit(new)).alias(c) for c, old, new in values]).alias("_columns"),
        edits.lines(F.col("_id"), F.col("_base_lines")).cast(f"array<{_UNIT}>").alias("_lines"),
        (F.lit(None).cast("string") if edits.head is None else edits.head(F.col("_id"), F.col("_base_lines"))).alias("_head"),
    )
    inside = F.exists("_lines", lambda u: u["edit"].isNotNull() | u["gap"].isNotNull()) | F.col("_head").isNotNull()
    for c in columns:
        inside = inside | F.col("_columns")[c].isNotNull()
    r = r.select("*", (~F.col("_dropped") & inside).alias("_inside"))
    state = F.struct(
        F.col("_dropped").alias("dropped"),
        F.col("_inside").alias("touched"),
        *[F.when(F.col("_inside"), F.col(x)).alias(x[1:]) for x in ("_columns", "_lines", "_head")],
    )
    return r.select("_id", state.alias("_state"))


def _edits(l: Column, r: Column) -> Column:
    """What two registers of one text come to."""
    return (
        F.when(l.isNull() & r.isNull(), SAME)
        .when(l.isNull() | r.isNull() | l.eqNullSafe(r), CLEAN)
        .when(l["text"].isNull() | r["text"].isNull(), EDIT_DELETE)
        .otherwise(EDIT_EDIT)
    )


def _text(base: Column, l: Column, r: Column) -> Column:
    """The merged text; conflicts take the base's."""
    return F.when(l.isNull() & r.isNull(), base).when(l.isNull(), r["text"]).when(r.isNull() | l.eqNullSafe(r), l["text"]).otherwise(base)


def _gaps(l: Column, r: Column) -> Column:
    return F.when(l.isNull() & r.isNull(), SAME).when(l.isNull() | r.isNull() | (l == r), CLEAN).otherwise(INSERT_INSERT)


def _gap(l: Column, r: Column) -> Column:
    """The merged insertion; conflicts insert nothing."""
    return F.when(l.isNull() | r.isNull() | (l == r), F.coalesce(l, r))


def merged(
    docs: DataFrame,
    left: Callable[[DataFrame], Edits],
    right: Callable[[DataFrame], Edits],
    columns: tuple[str, ...] = ("lang", "source"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for every id that base or branches have: id, text, columns, counts and conflicts.

    ``left`` and ``right`` take the base (``_id``, ``_text``, ``_c_`` and each column) and give their edits.
    The replicas meet in one grouping by id; each line, gap and column is a register. Changes of one side, and
    equal ones, count in n_clean; others count as conflicts (n_edit_edit, n_edit_delete, n_insert_insert),
    take the base's state and are recorded in ``conflicts`` (name, left, right).

    A dropped row counts alone: clean if the other branch drops or leaves it, else a conflict that keeps
    the base's row. Added rows count by id: equal ones as one clean change, others as a conflict
    without a row. An added row whose id the base has is such a conflict too and changes nothing. Absent rows
    have null text and columns.

    Nulls count as ''. Of rows with one id that of the smallest values is the base's; null is an id like
    others. An empty text is one empty line; a text whose lines are all dropped is empty. An empty table
    gives no rows; other columns do no harm.
    """
    private_names(docs, id_col, text_col, *columns)
    rows = unique_rows(docs, columns, id_col, text_col)
    met = rows.select("_id", F.struct("_text", *[f"_c_{c}" for c in columns]).alias("_base"))
    new = F.lit(None).cast("struct<_text:string," + ",".join(f"`_c_{c}`:string" for c in columns) + ">").alias("_new")
    met = met.select("*", new)
    for side, edits in (("_l", left(rows)), ("_r", right(rows))):
        met = met.unionByName(replica(rows, edits, columns).withColumnRenamed("_state", side), allowMissingColumns=True)
        if edits.added is not None:
            values = F.struct(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c_{c}") for c in columns]).alias("_new")
            met = met.unionByName(edits.added.select(F.col(id_col).alias("_id"), values), allowMissingColumns=True)
    m = met.groupBy("_id").agg(*[F.min(c).alias(c) for c in ("_base", "_l", "_r", "_new")], F.max("_new").alias("_newest"))
    return _resolved(m, columns, id_col, text_col)


def _resolved(m: DataFrame, columns: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    l, r = F.col("_l"), F.col("_r")
    unit = lambda s, i: F.get(s["lines"], i)
    registers = F.transform(
        F.split("_base._text", "\n", -1),
        lambda x, i: F.struct(
            _edits(unit(l, i)["edit"], unit(r, i)["edit"]).alias("kind"),
            _text(x, unit(l, i)["edit"], unit(r, i)["edit"]).alias("text"),
            _gaps(unit(l, i)["gap"], unit(r, i)["gap"]).alias("gap_kind"),
            _gap(unit(l, i)["gap"], unit(r, i)["gap"]).alias("gap"),
        ),
    )
    m = m.withColumn("_m", registers)
    there, added = F.col("_base").isNotNull(), F.col("_new").isNotNull()
    drop_l, drop_r = F.coalesce(l["dropped"], F.lit(False)), F.coalesce(r["dropped"], F.lit(False))
    drops = drop_l | drop_r
    fought = (drop_l & F.coalesce(r["touched"], F.lit(False))) | (drop_r & F.coalesce(l["touched"], F.lit(False)))
    agreed = F.col("_new") == F.col("_newest")
    kinds = [_edits(l["columns"][c], r["columns"][c]) for c in columns]
    gaps = _gaps(l["head"], r["head"])
    inside = lambda k: (
        F.size(F.filter("_m", lambda u: u["kind"] == k)) + F.size(F.filter("_m", lambda u: u["gap_kind"] == k))
        + (gaps == k).cast("int") + sum((x == k).cast("int") for x in kinds)
    )
    one = lambda c: c.cast("int")

    def counts(k: int, row: Column, new: Column) -> Column:
        of_base = F.when(drops, row).otherwise(inside(k))
        return (F.when(there, of_base).otherwise(F.lit(0)) + F.when(added, new).otherwise(F.lit(0))).cast("long")

    zero = F.lit(0)
    lines = F.concat(F.array(_gap(l["head"], r["head"])), F.flatten(F.transform("_m", lambda u: F.array(u["text"], u["gap"]))))
    stays = ~drops | fought
    new = ~there & agreed
    value = lambda base, changed, name: (
        F.when(there & drops & fought, base).when(there & stays, changed).when(new, F.col("_new")[name])
    )
    return m.select(
        F.col("_id").alias(id_col),
        value(F.col("_base._text"), F.array_join(lines, "\n"), "_text").alias(text_col),  # nulls are passed over
        *[value(F.col(f"_base._c_{c}"), _text(F.col(f"_base._c_{c}"), l["columns"][c], r["columns"][c]), f"_c_{c}").alias(c) for c in columns],
        counts(CLEAN, one(~fought), one(~there & agreed)).alias("n_clean"),
        counts(EDIT_EDIT, zero, zero).alias("n_edit_edit"),
        counts(EDIT_DELETE, one(fought), zero).alias("n_edit_delete"),
        counts(INSERT_INSERT, zero, one(there | ~agreed)).alias("n_insert_insert"),
        _recorded(l, r, columns, fought, drops, there, added, agreed).alias("conflicts"),
    )


def _recorded(l: Column, r: Column, columns: tuple[str, ...], fought: Column, drops: Column, there: Column, added: Column, agreed: Column) -> Column:
    """name, left and right of every conflict: what each branch wanted; null is a drop."""
    entry = lambda name, x, y: F.struct(name.alias("name"), x.alias("left"), y.alias("right"))
    unit = lambda s, i: F.get(s["lines"], i)
    of_lines = F.flatten(F.transform(
        "_m",
        lambda u, i: F.array(
            F.when(u["kind"] > CLEAN, entry(i.cast("string"), unit(l, i)["edit"]["text"], unit(r, i)["edit"]["text"])),
            F.when(u["gap_kind"] > CLEAN, entry(F.concat(i.cast("string"), F.lit("+")), unit(l, i)["gap"], unit(r, i)["gap"])),
        ),
    ))
    others = [
        F.when(_edits(l["columns"][c], r["columns"][c]) > CLEAN, entry(F.lit(c), l["columns"][c]["text"], r["columns"][c]["text"])) for c in columns
    ]
    others.append(F.when(_gaps(l["head"], r["head"]) > CLEAN, entry(F.lit("head"), l["head"], r["head"])))
    wanted = lambda s: F.when(~F.coalesce(s["dropped"], F.lit(False)), "changed")
    whole = [F.when(fought, entry(F.lit("row"), wanted(l), wanted(r)))]
    whole.append(F.when(added & (there | ~agreed), entry(F.lit("new"), F.to_json("_new"), F.to_json("_newest"))))
    return F.array_compact(F.when(there & ~drops, F.concat(F.array(*whole, *others), of_lines)).otherwise(F.array(*whole)))
