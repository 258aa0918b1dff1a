"""Citations by a dictionary of law names, and replacements in one pass: opt-in forms of P11 and C7."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may open and close a quoted name, an article, and what stands between articles of one law.
OPENERS, CLOSERS = "「『〈《“‘\"'([", "」』〉》”’\"')]"
ARTICLE = r"제\d+조(?:의\d+)?(?:\s*제\d+항)?(?:\s*제\d+호)?"
BETWEEN = r"(?:\s*[,·ㆍ]\s*|\s*(?:및|와|과|또는)\s*|\s+)"

CITED = "array<struct<law:string,article:string,citation:string,start:int,stop:int>>"
_FIRST = re.compile(rf"[{re.escape(CLOSERS)}]?\s*({ARTICLE})")
_NEXT = re.compile(rf"{BETWEEN}({ARTICLE})")


def _hangul(x: str) -> bool:
    return "가" <= x <= "힣"


class Names:
    """Law names as an automaton; of names that begin or overlap, the first and longest counts."""

    def __init__(self, names: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for name in names:
            if name:
                self.automaton.add_word(name, name)
        self.automaton.make_automaton()

    def citations(self, text: str) -> list[dict]:
        out: list[dict] = []
        if not len(self.automaton):
            return out
        for last, name in self.automaton.iter_long(text):
            start = last + 1 - len(name)
            if start and _hangul(text[start - 1]):
                continue  # the end of a longer name that is not known
            at, pattern = last + 1, _FIRST
            while m := pattern.match(text, at):
                article = re.sub(r"\s+", " ", m[1])
                begin = m.start(1) if pattern is _NEXT else start - int(bool(m[0][0] in CLOSERS and start and text[start - 1] in OPENERS))
                out.append({"law": name, "article": article, "citation": f"{name} {article}", "start": begin, "stop": m.end()})
                at, pattern = m.end(), _NEXT
        return out


def cited(x: Column, names: list[str]) -> Column:  # P11
    """Every citation of a law in ``names``, in order: law, article, citation, and the code points from start to stop.

    Names may have several words and stand in quotes. Articles that follow one another share the law's name;
    of these only the first has the name in its span. A name that ends a longer unknown one is none. ``names`` is
    a register of bounded size. Null gives null.
    """
    made: list[Names] = []

    @F.arrow_udf(CITED)
    def find(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Names(names))
        kind = pa.list_(pa.struct([("law", pa.string()), ("article", pa.string()), ("citation", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        return pa.array([None if t is None else made[0].citations(t) for t in texts.to_pylist()], kind)

    return find(x)


def corrected_at(answer: Column, spans: Column) -> Column:  # C7
    """All spans (start, stop, right) replaced at once, in order of their starts; a span that begins inside an earlier one is left out.

    Only the first line of a replacement is used. Nothing that was put in is looked at again.
    """
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    piece = lambda acc, s: F.concat(acc["done"], F.substr(answer, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(F.split(s["right"], "\n"), 1))
    put = lambda acc, s: F.when(
        (s["start"] >= acc["at"]) & s["right"].isNotNull(), F.struct(s["stop"].cast("int").alias("at"), piece(acc, s).alias("done"))
    ).otherwise(acc)
    return F.when(spans.isNull(), answer).otherwise(F.aggregate(F.array_sort(spans, order), start, put, lambda acc: F.concat(acc["done"], F.substr(answer, acc["at"] + 1))))


def corrected_once(answer: Column, pairs: Column) -> Column:  # C7
    """Replacements (wrong, right) in one pass: at each place the longest wrong text counts, and what was put in is not looked at again."""

    @F.arrow_udf("string")
    def replace(answers: pa.Array, all_pairs: pa.Array) -> pa.Array:
        out = []
        for a, ps in zip(answers.to_pylist(), all_pairs.to_pylist(), strict=True):
            new = {p["wrong"]: p["right"].split("\n")[0] for p in reversed(ps or []) if p["wrong"] and p["right"] is not None}
            if a is not None and new:
                either = "|".join(re.escape(w) for w in sorted(new, key=len, reverse=True))
                a = re.sub(either, lambda m: new[m[0]], a)
            out.append(a)
        return pa.array(out, pa.string())

    return replace(answer, pairs)
