"""Expansion by thousands of rules: an automaton over literals finds candidates, their patterns decide (P1)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser as syntax

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _runs(parsed) -> list[set[str] | None]:
    """For each part of a sequence the strings of which a match of that part holds at least one; None: not known."""
    out: list[set[str] | None] = []
    run = ""
    for kind, value in parsed:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        out.append({run} if run else None)
        run = ""
        if kind is op.SUBPATTERN and not value[1] & re.IGNORECASE:
            out.append(_best(value[3]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            out.append(_best(value[2]))
        elif kind is op.BRANCH:
            parts = [_best(p) for p in value[1]]
            out.append(None if None in parts else set().union(*parts))
    out.append({run} if run else None)
    return out


def _best(parsed) -> set[str] | None:
    known = [s for s in _runs(parsed) if s]
    return max(known, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def literals(pattern: str) -> set[str] | None:
    """Strings of which every match of the pattern holds at least one, as long as can be; None where there are none."""
    parsed = syntax.parse(pattern)
    return None if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) else _best(parsed)


#: Texts that a task holds as strings at once, with what comes of them; its input may come in far larger batches.
TEXTS = 256


class Rules:
    """Ordered rules (pattern, expansion). Built once a task; patterns are compiled when they are first needed."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules, self.compiled = rules, {}
        self.always, by_literal = [], {}
        for i, (pattern, _) in enumerate(rules):
            own = literals(pattern)
            if own is None:
                self.always.append(i)
            for x in own or ():
                by_literal.setdefault(x, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for x, ids in by_literal.items():
            self.automaton.add_word(x, ids)
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        found = set(self.always)
        if len(self.automaton):
            for _, ids in self.automaton.iter(text):
                found.update(ids)
        return sorted(found)

    def matching(self, text: str) -> list[int]:
        return [i for i in self.candidates(text) if self._pattern(i).search(text)]

    def _pattern(self, i: int) -> re.Pattern:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i][0])
        return self.compiled[i]

    def expanded(self, text: str) -> str:
        hits = self.matching(text)
        return f"{text} {' '.join(self.rules[i][1] for i in hits)}".strip() if hits else text


def expand_query(query: Column, rules: list[tuple[str, str]]) -> Column:  # P1
    """``text.expand_query`` for large rule sets, with Python's patterns. Cost follows a text's length and
    what it matches, hardly the number of rules. Nulls stay null. A few texts at a time are strings."""

    @F.arrow_udf("string")
    def expand(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from expansions(batches, Rules(rules))

    return expand(query)


def expansions(batches: Iterator[pa.Array], rules: Rules) -> Iterator[pa.Array]:
    for texts in batches:
        for at in range(0, len(texts), TEXTS):
            yield pa.array([None if t is None else rules.expanded(t) for t in texts.slice(at, TEXTS).to_pylist()], pa.string())
        del texts  # before the next batch comes
