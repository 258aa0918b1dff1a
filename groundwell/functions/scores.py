"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(distance: Column) -> Column:  # P2
    return F.round(1 - distance, 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:  # J8
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def token_f1(reference: Column, candidate: Column) -> Column:  # L2
    """Greedy matching of token vectors (arrays of vectors): F1 of mean best cosines, 4 digits."""
    best = lambda xs, ys: F.aggregate(
        F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: cosine(x, y)))), F.lit(0.0), lambda s, x: s + x
    ) / F.size(xs)
    recall, precision = best(reference, candidate), best(candidate, reference)
    return F.round(2 * precision * recall / (precision + recall), 4)


#: Digits of other scripts that a pattern for digits takes: each run stands for 0 to 9.
DIGITS = ["".join(chr(zero + i) for i in range(10)) for zero in (0xFF10, 0x660, 0x6F0, 0x966, 0x9E6, 0xE50)]


def judged(reply: Column) -> Column:  # P13
    number = F.translate(F.regexp_extract(reply, r"(?U)[\d.]+", 0), "".join(DIGITS), "0123456789" * len(DIGITS)).try_cast("double")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))  # both would pass over a null
    return F.when(number.isNull(), F.lit(0.5)).otherwise(F.round(clamped, 4))
