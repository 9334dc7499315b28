"""Many patterns or terms in one pass over a text: an Aho-Corasick automaton of literals, run in Arrow batches.

A regular expression is looked for only in texts that hold one of its literals, so a text costs
one walk through the automaton and a check of the few patterns that it may hold, however many there
are. Patterns without a literal are always checked. Letter case doesn't matter. A worker process
builds an automaton once and keeps it.
"""

from __future__ import annotations

import functools
import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters that a pattern without regard to case takes for another, beyond case folding.
_ALIKE = str.maketrans({"ı": "i", "̇": None})


def folded(text: str) -> str:
    """A text as literals are looked for: case folded, dotless and dotted i alike."""
    return text.casefold().translate(_ALIKE)


def literals(pattern: str) -> set[str] | None:
    """Literals of which every match of a pattern holds one; None where it needs none."""
    from re import _parser as parser

    return _needed(parser.parse(pattern, re.IGNORECASE))


def _needed(items) -> set[str] | None:
    found: list[set[str]] = []
    run = ""
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name == "AT":  # a boundary stands between letters, not in place of them
            continue
        inner = None
        if name == "SUBPATTERN":
            inner = _needed(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0]:
            inner = _needed(value[2])
        elif name == "BRANCH":
            each = [_needed(x) for x in value[1]]
            inner = None if None in each else set().union(*each)
        if run:
            found.append({folded(run)})
            run = ""
        if inner:
            found.append(inner)
    if run:
        found.append({folded(run)})
    found = [x for x in found if all(x)]
    return max(found, key=lambda x: (min(map(len, x)), -len(x))) if found else None


class Patterns:
    """Which of many regular expressions a text holds."""

    def __init__(self, patterns: tuple[str, ...]):
        import ahocorasick

        self.checks = [re.compile(p, re.IGNORECASE).search for p in patterns]
        self.always, owners = [], {}
        for i, pattern in enumerate(patterns):
            needed = literals(pattern)
            if needed is None:
                self.always.append(i)
            for word in needed or ():
                owners.setdefault(word, set()).add(i)
        self.automaton = ahocorasick.Automaton()
        for word, ids in owners.items():
            self.automaton.add_word(word, frozenset(ids))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def held(self, text: str | None) -> list[int]:
        """Numbers of the patterns that a text holds."""
        if not text:
            return []
        near = set(self.always)
        if not self.empty:
            for ids in {ids for _, ids in self.automaton.iter(folded(text))}:
                near |= ids
        return [i for i in near if self.checks[i](text)]


class Terms:
    """Which of many terms stand in a text, letter by letter."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.empty = not terms
        for i, term in enumerate(terms):
            self.automaton.add_word(term, i)
        if terms:
            self.automaton.make_automaton()

    def held(self, text: str | None) -> set[int]:
        return set() if self.empty or not text else {i for _, i in self.automaton.iter(text)}


@functools.lru_cache(maxsize=16)
def _patterns(patterns: tuple[str, ...]) -> Patterns:
    return Patterns(patterns)


def counted(groups: list[list[str]], *texts: Column) -> Column:
    """For each text, in turn, how many patterns of each group it holds: an array of arrays of int."""
    patterns = tuple(dict.fromkeys(p for group in groups for p in group))
    number = {p: i for i, p in enumerate(patterns)}
    member: list[list[int]] = [[] for _ in patterns]
    for g, group in enumerate(groups):
        for p in group:
            member[number[p]].append(g)
    n = len(groups)

    @F.arrow_udf("array<array<int>>")
    def run(*columns: pa.Array) -> pa.Array:
        own = _patterns(patterns)
        flat: list[int] = []
        lists = [c.to_pylist() for c in columns]
        for row in zip(*lists, strict=True):
            before = counts = None
            for text in row:
                if counts is None or text != before:
                    before, counts = text, [0] * n
                    for i in own.held(text):
                        for g in member[i]:
                            counts[g] += 1
                flat += counts
        rows = len(columns[0])
        inner = pa.ListArray.from_arrays(pa.array(range(0, rows * len(columns) * n + 1, n) if n else [0] * (rows * len(columns) + 1), pa.int32()), pa.array(flat, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(range(0, rows * len(columns) + 1, len(columns)), pa.int32()), inner)

    return run(*texts)


#: Automata of terms that a worker keeps, and how many terms need none.
KEPT, FEW = 16, 24
_TERMS: dict[str, Terms] = {}


def terms_held(broadcast, *texts: Column) -> Column:
    """The terms of a broadcast list that stand in one of the texts, in the list's order: an array of string."""
    name = uuid.uuid4().hex

    @F.arrow_udf("array<string>")
    def run(*columns: pa.Array) -> pa.Array:
        terms = broadcast.value
        own = _TERMS.get(name)
        if own is None:
            if len(_TERMS) >= KEPT:
                _TERMS.pop(next(iter(_TERMS)))
            own = _TERMS[name] = Terms(terms)
        lists = [c.to_pylist() for c in columns]
        return pa.array([[terms[i] for i in sorted(set().union(*(own.held(t) for t in row)))] for row in zip(*lists, strict=True)], pa.list_(pa.string()))

    return run(*texts)


def any_terms_held(terms: DataFrame | list[str], *texts: Column, block: int = 50_000, few: int = FEW) -> Column:
    """The terms (a list, or one column of string) that stand in one of the texts: an array of string.

    A few terms are looked for one by one, in generated code. More go out in blocks of about
    ``block``, as automata; a worker walks each text once for each block and keeps ``KEPT`` of them, so
    more than KEPT blocks are right but slow.
    """
    spark = SparkSession.active()
    if isinstance(terms, list):
        found = sorted({x for x in terms if x})
        terms = spark.createDataFrame([(x,) for x in found], "term string") if len(found) > block else None
        column = "term"
    else:
        (column,) = terms.columns
        terms = terms.where(F.col(column) != "").distinct()
        found = sorted(r[0] for r in terms.limit(block + 1).collect())
    if len(found) <= few:
        own = F.array(*map(F.lit, found)).cast("array<string>")
        held = lambda row: F.filter(own, lambda k: reduce(lambda a, b: a | b, [F.contains(row[i], k) for i in range(len(texts))]))
        return F.transform(F.array(F.array(*texts)), held)[0]
    if len(found) <= block:
        return terms_held(spark.sparkContext.broadcast(found), *texts)
    blocks = -(-terms.count() // block)
    parts = []
    for i in range(blocks):
        own = terms.where(F.pmod(F.xxhash64(column), F.lit(blocks)) == i).collect()
        parts.append(terms_held(spark.sparkContext.broadcast(sorted(r[0] for r in own)), *texts))
    return F.concat(*parts)
