"""Fill-in-the-middle: a lazy matcher counts units, then walks again to the two places of the cut."""

from __future__ import annotations

import re
from collections import deque
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import private_names

#: Units of a text: words of ASCII letters, and every other code point by itself.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


def counted(text: str, unit: re.Pattern) -> int:
    """Units of a text. Matches are let go one by one: nothing grows with their number."""
    n = count()
    deque(zip(unit.finditer(text), n, strict=False), maxlen=0)
    return next(n)


def walked(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int]:
    """Code points before the ends of two units, by their ranks in ascending order (0: the beginning)."""
    matches = unit.finditer(text)
    at = next(islice(matches, first - 1, None)).end() if first else 0
    return at, next(islice(matches, second - first - 1, None)).end() if second > first else at


def _places(unit: str):
    compiled = re.compile(unit, re.DOTALL)

    @F.arrow_udf("n long, prefix_chars long, middle_chars long")
    def places(text: pa.Array, h1: pa.Array, h2: pa.Array, cut: pa.Array) -> pa.Array:
        n, prefix, middle = [], [], []
        for i in range(len(text)):  # one text at a time is a Python string
            t = text[i].as_py()
            n.append(units := counted(t, compiled))
            if cut[i].as_py():
                ranks = sorted((h1[i].as_py() % (units + 1), h2[i].as_py() % (units + 1)))
                a, b = walked(t, compiled, *ranks)
                prefix.append(a)
                middle.append(b - a)
            else:
                prefix.append(None)
                middle.append(None)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, prefix, middle)], ["n", "prefix_chars", "middle_chars"])

    return places


def transformed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
    markers: tuple[str, str, str] = MARKERS,
    unit: str = UNIT,
) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and output of every row.

    Numbers h1 to h4 come from the digest of seed and id. The prefix ends after the smaller of
    h1 and h2 modulo n + 1 units, the middle after the larger. Of the forms, psm puts prefix, suffix and
    middle after their markers, spm suffix, prefix and middle; plain is the text itself. ``unit`` is a pattern
    whose matches leave no gaps.

    Texts go to Python once and only places come back; whole texts are put together in the JVM. Python
    holds one text and one match at a time.

    Null and empty texts, and texts that hold a marker, stay plain; null ids count as ''. Rows are
    looked at by themselves: repeated rows give equal rows, no rows give none, and other columns do no harm.
    """
    private_names(docs, id_col, text_col)
    p, s, m = markers
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn("_digest", digest)
    number = lambda k: F.conv(F.substring("_digest", 8 * k - 7, 8), 16, 10).cast("long")
    plain = (F.col("_text") == "") | (number(3) % 100 >= 100 - plain_percent)
    for marker in markers:
        plain = plain | F.contains("_text", F.lit(marker))
    form = F.when(plain, "plain").when(number(4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("_form", form)
    rows = rows.withColumn("_at", _places(unit)(F.col("_text"), number(1), number(2), F.col("_form") != "plain"))
    a, b = F.col("_at.prefix_chars").cast("int"), F.col("_at.middle_chars").cast("int")
    prefix, middle = F.substr("_text", F.lit(1), a), F.substr("_text", a + 1, b)
    suffix = F.substr("_text", a + b + 1)
    output = (
        F.when(F.col("_form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .when(F.col("_form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
        .otherwise(F.col("_text"))
    )
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_at.n").alias("n"),
        F.col("_form").alias("form"),
        F.col("_at.prefix_chars").alias("prefix_chars"),
        F.col("_at.middle_chars").alias("middle_chars"),
        output.alias("output"),
    )


def restored(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text before, from output and form alone: its parts hold no marker, so each marker stands once."""
    p, s, m = markers
    after = lambda x: F.locate(x, output) + len(x)
    between = lambda x, y: F.substr(output, after(x), F.locate(y, output) - after(x))
    last = F.substr(output, after(m))
    psm = F.concat(between(p, s), last, between(s, m))
    spm = F.concat(between(p, m), last, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
