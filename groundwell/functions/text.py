
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CITATION, CORE_MARKERS, CUT, EXPANSIONS, IMAGE_URL


def strip(x: Column) -> Column:
    """Unicode white space goes from both ends, as no-break and ideographic spaces do in Python."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def expand_query(query: Column, rules: list[tuple[str, str]] | None = None) -> Column:  # P1
    """Expansions of all matching rules, in their order; a query without a match is left untouched."""
    rules = EXPANSIONS if rules is None else rules
    hits = F.array_compact(F.array(*[F.when(query.rlike(f"(?d){p}"), F.lit(e)) for p, e in rules]))
    return F.when(F.size(hits) > 0, strip(F.concat_ws(" ", query, F.array_join(hits, " ")))).otherwise(query)


def truncated(x: Column, n: int, marker: str = CUT) -> Column:  # P8
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit(marker))).otherwise(x)


def preview(x: Column, n: int = 200) -> Column:  # P22
    return F.replace(F.left(x, F.lit(n)), F.lit("\n"), F.lit(" "))


def core_text(x: Column, markers: list[str] | None = None) -> Column:  # P10
    """Section heads go, then everything from the earliest marker on; lines are trimmed and joined."""
    markers = CORE_MARKERS if markers is None else markers
    x = F.regexp_replace(x, r"\([1-5]\)(?U)\s*[^\n]+\n?", "")
    x = F.regexp_replace(x, r"[①-⑤](?U)\s*", "")
    cut = "|".join(rf"\Q{m}\E" for m in markers)
    x = F.regexp_replace(x, rf"(?s)(?:{cut}).*\z", "")
    lines = F.transform(F.split(x, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip)
    return F.array_join(F.filter(lines, lambda s: s != ""), " ")


def citations(x: Column, pattern: str = CITATION) -> Column:  # P11, U2
    """Distinct citations in order of their first places."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(f"(?U){pattern}"), F.lit(0)), strip))


def law_name(citation: Column) -> Column:  # P12
    return strip(F.element_at(F.split(citation, r"(?U)\s*제\d+조"), 1))


def without_markdown(x: Column) -> Column:  # P19
    return F.translate(x, "*#", "")


def image_url(prompt: Column, key: Column) -> Column:  # P20
    """The seed follows from the request's key, so that a retried task builds the same address."""
    quoted = F.replace(F.replace(F.replace(F.url_encode(prompt), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
    quoted = F.replace(quoted, F.lit("*"), F.lit("%2A"))
    seed = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 1000 + 1
    return F.concat(F.lit(IMAGE_URL[0]), quoted, F.lit(IMAGE_URL[1]), seed.cast("string"))


def cache_buster(url: Column) -> Column:  # P29
    return F.concat(url, F.lit("?v=1"))


def any_word(x: Column, words: list[str]) -> Column:  # P17
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])
