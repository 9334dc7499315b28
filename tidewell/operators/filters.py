"""Scopes and predicates of the listing query, and the query itself.

A listing query is a set of predicates keyed by field, so that a facet can be counted under
every predicate but its own without building the query again.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES, MAX_PAGE_SIZE, PAGE_SIZE


# The scripts that an English title may not hold.
FOREIGN_SCRIPTS = r"[֐-׿؀-ۿЀ-ӿऀ-ॿ฀-๿一-鿿぀-ヿ가-힯]"
SORTABLE = ("deadline", "title", "organization", "country", "category", "date_scraped")
SEARCHED = ("title", "organization", "summary", "vertical", "country", "eligibility")


@dataclass
class Listing:
    """What a reader asked for; empty fields don't restrict."""

    archived: bool = False
    approved: bool = False
    new_today: bool = False
    english_only: bool = True
    classified_only: bool = True
    work_type: str = ""
    study_type: str = ""
    category: list[str] = field(default_factory=list)
    verticals: list[str] = field(default_factory=list)
    country: list[str] = field(default_factory=list)
    region: list[str] = field(default_factory=list)
    source_website: list[str] = field(default_factory=list)
    organization: list[str] = field(default_factory=list)
    deadline_after: datetime.date | None = None
    deadline_before: datetime.date | None = None
    search: str = ""
    sort_by: str = "deadline"
    sort_dir: str = "asc"
    page: int = 1
    page_size: int = PAGE_SIZE


def active(as_of: datetime.date) -> Column:
    return (F.col("status") == "Active") & ((F.col("deadline") >= F.lit(as_of)) | F.col("deadline").isNull())


def scope(q: Listing, as_of: datetime.date) -> Column:
    """Approved before archived before active."""
    if q.approved:
        return F.col("approved")
    if q.archived:
        return F.col("status") == "Expired"
    return active(as_of)


def english() -> Column:
    return ~F.col("title").rlike(FOREIGN_SCRIPTS)


def classified() -> Column:
    return F.col("verticals") != ""


def checked_categories(names: list[str]) -> list[str]:
    unknown = [x for x in names if x not in CATEGORIES]
    if unknown:
        raise ValueError(f"unknown categories: {unknown}")
    return names


def labels(column: str = "verticals") -> Column:
    """A joined label string as an array."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def any_label(wanted: list[str]) -> Column:
    """A label contains a wanted one, or the raw source label equals it, without regard to case."""
    tests = [F.lower("verticals").contains(x.lower()) | (F.lower("vertical") == x.lower()) for x in wanted]
    return reduce(lambda a, b: a | b, tests)


def tokens(text: Column) -> Column:
    """Lower-cased words with accents folded, as the search index sees them."""
    return F.split(F.lower(fold(text)), r"[^\p{L}\p{N}]+")


def fold(text: Column) -> Column:
    return F.translate(text, "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC")


def search(text: str) -> Column:
    """Each of the first six words begins a word of a column; a quote falls back to substrings."""
    words = text.split()[:6]
    if not words:
        return F.lit(True)
    if any('"' in w for w in words):
        low = text.strip().lower()
        return reduce(lambda a, b: a | b, [F.lower(c).contains(low) for c in ("title", "organization", "summary", "vertical")])
    import re
    import unicodedata

    def one(whole: Column, word: str) -> Column:
        plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
        parts = [p for p in re.split(r"[\W_]+", plain) if p]
        if not parts:
            return F.lit(False)
        phrase = r"[^\p{L}\p{N}\x01]+".join(parts)  # never from one column into the next
        return whole.rlike(rf"(^|[^\p{{L}}\p{{N}}]){phrase}")

    folded = F.lower(fold(F.concat_ws("\x01", *SEARCHED)))
    return F.transform(F.array(folded), lambda whole: reduce(lambda a, b: a & b, [one(whole, w) for w in words]))[0]


def predicates(q: Listing, as_of: datetime.date) -> dict[str, Column]:
    """The predicates of a query by field."""
    found = {"scope": scope(q, as_of)}
    if q.new_today:
        found["new_today"] = F.to_date("date_scraped") == F.lit(as_of)
    for name in ("work_type", "study_type"):
        if getattr(q, name):
            found[name] = F.col(name) == getattr(q, name)
    if q.english_only:
        found["english"] = english()
    if q.classified_only:
        found["classified"] = classified()
    if q.category:
        found["category"] = F.col("category").isin(checked_categories(q.category))
    if q.verticals:
        found["verticals"] = any_label(q.verticals)
    for name in ("country", "region", "source_website", "organization"):
        if getattr(q, name):
            found[name] = F.col(name).isin(getattr(q, name))
    if q.deadline_after:
        found["deadline_after"] = F.col("deadline") >= F.lit(q.deadline_after)
    if q.deadline_before:
        found["deadline_before"] = F.col("deadline") <= F.lit(q.deadline_before)
    if q.search.strip():
        found["search"] = search(q.search)
    return found


def all_of(tests) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filtered(opps: DataFrame, q: Listing, as_of: datetime.date) -> DataFrame:
    return opps.where(all_of(predicates(q, as_of).values()))


def ordering(q: Listing) -> list[Column]:
    column = F.col(q.sort_by if q.sort_by in SORTABLE else "deadline")
    return [column.desc_nulls_last() if q.sort_dir == "desc" else column.asc_nulls_last(), F.col("id").asc()]


def page(opps: DataFrame, q: Listing, as_of: datetime.date) -> DataFrame:
    """One page in order, with total and number of pages on every row."""
    size = min(max(q.page_size, 1), MAX_PAGE_SIZE)
    found = filtered(opps, q, as_of)
    total = found.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    rows = found.orderBy(*ordering(q)).offset((max(q.page, 1) - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))  # one row


def option_filter(options: DataFrame, text: str, ticked: list[str]) -> DataFrame:
    """Options (value) that contain a text or are ticked."""
    return options.where(F.lower("value").contains(text.lower()) | F.col("value").isin(ticked))


def panel_search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text.lower()) for c in columns]))


def allowed_domain(email: Column, domains: list[str]) -> Column:
    """The mail domain is a listed one or lies below one."""
    host = F.lower(F.substring_index(email, "@", -1))
    return F.coalesce(email.contains("@") & reduce(lambda a, b: a | b, [(host == d) | host.endswith(f".{d}") for d in domains], F.lit(False)), F.lit(False))
