"""Classifiers that score a title and a body against weighted pattern lists.

All lists are looked for in one pass (``automaton``): a row's evidence is a few small counts, which
the classifiers judge in column expressions. Alone a classifier makes its own evidence; ingest makes
one for all of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ENABLED_CATEGORIES
from .automaton import counted
from .lexicons import CATEGORY_PATTERNS, IMPLEMENTATION_PATTERNS, RESEARCH_PATTERNS, STUDY_PATTERNS, STUDY_SPECIFICITY, VERTICAL_PATTERNS

TITLE, BODY, HINT = 3, 1, 2
#: How points, specificity and place share a number: at most so many labels, and specificities below STEP / LABELS.
LABELS, STEP = 1_000, 1_000_000
STUDY_BODY = 2000


class Evidence:
    """How many patterns of each of several lists a title, a body and the body's beginning hold, counted in one pass over each."""

    def __init__(self, lists: list[list[str]], title: Column, body: Column | None = None):
        """body: none where title is what ``column`` of an equal evidence gave, stored with its row."""
        self.at = {tuple(x): i for i, x in enumerate(lists)}
        self.column = title if body is None else counted(lists, title, body, F.substring(body, 1, STUDY_BODY))

    def _count(self, text: int, patterns: list[str]) -> Column:
        return self.column[text][self.at[tuple(patterns)]]

    def title(self, patterns: list[str]) -> Column:
        return self._count(0, patterns)

    def body(self, patterns: list[str]) -> Column:
        return self._count(1, patterns)

    def beginning(self, patterns: list[str]) -> Column:
        return self._count(2, patterns)

    def score(self, patterns: list[str]) -> Column:
        """Three for each pattern in the title, one for each in the body."""
        return TITLE * self.title(patterns) + BODY * self.body(patterns)


def judged_once(evidence: Evidence, judge: Callable[[Evidence], Column]) -> Column:
    """What judge makes of evidence that is counted once a row, however often judge asks."""
    lists = [list(x) for x in evidence.at]
    return F.transform(F.array(evidence.column), lambda seen: judge(Evidence(lists, seen)))[0]


def category(title: Column, body: Column, hint: Column | None = None, lexicon: dict[str, list[str]] = CATEGORY_PATTERNS, enabled: list[str] = ENABLED_CATEGORIES, seen: Evidence | None = None) -> Column:
    """The enabled category with the best score, ties in the lexicon's order; Other without any."""
    own = {label: patterns for label, patterns in lexicon.items() if label in enabled}
    if seen is None:
        return judged_once(Evidence(list(own.values()), title, body), lambda e: category(title, body, hint, lexicon, enabled, e))
    scores = {label: seen.score(patterns) + (F.when(hint == label, HINT).otherwise(0) if hint is not None else 0) for label, patterns in own.items()}
    best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, (x, s) in enumerate(scores.items()))))
    return F.when(best["s"] > 0, best["x"]).otherwise("Other")


def verticals(title: Column, body: Column, lexicon: dict[str, list[str]] = VERTICAL_PATTERNS, threshold: int = 2, seen: Evidence | None = None) -> Column:
    """All labels that score the threshold, as an array in the lexicon's order: a hit in the title is enough, or several in the body."""
    if seen is None:
        return judged_once(Evidence(list(lexicon.values()), title, body), lambda e: verticals(title, body, lexicon, threshold, e))
    return F.filter(F.array(*(F.when(seen.score(p) >= threshold, label) for label, p in lexicon.items())), lambda x: x.isNotNull())


def term_patterns(terms: list[str], least: int = 4) -> list[str]:
    """Patterns for plain terms: whole words, any white space between them."""
    return [r"\b" + r"\s+".join(map(re.escape, t.split())) + r"\b" for t in terms if len(t.strip()) >= least]


def work_type(title: Column, body: Column, research: list[str] = RESEARCH_PATTERNS, implementation: list[str] = IMPLEMENTATION_PATTERNS, threshold: int = 3, margin: int = 2, seen: Evidence | None = None) -> Column:
    """Research or Implementation if one leads clearly, else blank."""
    if seen is None:
        return judged_once(Evidence([research, implementation], title, body), lambda e: work_type(title, body, research, implementation, threshold, margin, e))
    r, i = seen.score(research), seen.score(implementation)
    return F.when((F.greatest(r, i) < threshold) | (F.abs(r - i) < margin), "").when(r > i, "Research").otherwise("Implementation")


def study_type(title: Column, body: Column, lexicon: dict[str, list[str]] = STUDY_PATTERNS, specificity: dict[str, int] = STUDY_SPECIFICITY, seen: Evidence | None = None) -> Column:
    """The kind of study with the best evidence, then the most specific, then the first; else blank.

    Each field counts once for a kind, however many of its patterns it holds.
    """
    if seen is None:
        return judged_once(Evidence(list(lexicon.values()), title, body), lambda e: study_type(title, body, lexicon, specificity, e))
    kinds = []
    for i, (label, patterns) in enumerate(lexicon.items()):
        points = TITLE * (seen.title(patterns) > 0).cast("int") + BODY * (seen.beginning(patterns) > 0).cast("int")
        kinds.append(points * STEP + (specificity.get(label, 0) * LABELS + LABELS - 1 - i))  # in the order of points, specificity and place
    best = F.greatest(*kinds)
    return F.when(best >= STEP, F.get(F.array(*map(F.lit, lexicon)), F.lit(LABELS - 1) - best % LABELS)).otherwise("")


def every_list(categories: dict[str, list[str]] = CATEGORY_PATTERNS, enabled: list[str] = ENABLED_CATEGORIES, labels: dict[str, list[str]] = VERTICAL_PATTERNS) -> list[list[str]]:
    """The lists that all four classifiers ask for, for one evidence."""
    return [*(p for label, p in categories.items() if label in enabled), *labels.values(), RESEARCH_PATTERNS, IMPLEMENTATION_PATTERNS, *STUDY_PATTERNS.values()]


def vertical_by_hint(text: Column, hints: list[tuple[str, list[str]]]) -> Column:
    """The first label with a hint that the text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), "")
    for label, words in hints:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), label)
    return out.otherwise("")
