"""Facets, statistics and audits: one scan each where the definition allows."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENABLED_CATEGORIES, VERTICALS
from .filters import Listing, all_of, labels, predicates

FACETS = ("country", "region", "source_website", "organization", "category", "funding_type")
FALLBACK = ("country", "region")
KEPT_SELECTED = ("country", "region", "source_website")
ORGANIZATION_CAP = 500


def present(column: str) -> Column:
    return F.col(column).isNotNull() & (F.trim(F.col(column)) != "")


def facets(opps: DataFrame, q: Listing, as_of: datetime.date) -> DataFrame:
    """(facet, values): the values of each field under every predicate but its own; one scan.

    A narrowed country or region facet that comes out empty shows all values; what is selected
    never disappears. Values are grouped before they meet, and only the first ``ORGANIZATION_CAP``
    organisations do.
    """
    tests = predicates(q, as_of)
    flagged = opps.select(*FACETS, *(test.alias(f"_{name}") for name, test in tests.items()))
    names = [f"_{name}" for name in tests]
    cells = [F.struct(F.lit(x).alias("facet"), F.when(present(x), F.col(x)).alias("value"), all_of(F.col(n) for n in names if n != f"_{x}").alias("holds")) for x in FACETS]
    grouped = flagged.select(F.explode(F.array(*cells)).alias("c")).where("c.value IS NOT NULL").groupBy("c.facet", "c.value").agg(F.max("c.holds").alias("holds"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("holds"), "value"))
    many = grouped.where("facet = 'organization' AND holds").withColumn("place", place).where(F.col("place") <= ORGANIZATION_CAP).select("facet", "value", "holds")
    few = grouped.where("facet <> 'organization'").where(F.col("holds") | F.col("facet").isin(*FALLBACK))
    lists = few.union(many).groupBy("facet").agg(F.array_sort(F.collect_list(F.when(F.col("holds"), F.col("value")))).alias("found"), F.array_sort(F.collect_list("value")).alias("whole"))
    none = F.array().cast("array<string>")
    own = opps.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, FACETS))).alias("facet")).join(F.broadcast(lists), "facet", "left")  # a row for each facet
    found = F.coalesce("found", none)
    found = F.when(F.col("facet").isin(*FALLBACK) & (F.size(found) == 0), F.coalesce("whole", none)).otherwise(found)
    for facet in KEPT_SELECTED:
        if chosen := getattr(q, facet, []):
            found = F.when(F.col("facet") == facet, F.array_sort(F.array_union(found, F.array(*map(F.lit, chosen))))).otherwise(found)
    ordered = F.array(*map(F.lit, ENABLED_CATEGORIES))
    kept = F.array_union(found, F.array(*map(F.lit, q.category))) if q.category else found
    shown = F.array_intersect(ordered, kept)  # in the order of the first
    found = F.when(F.col("facet") == "category", F.when(F.size(shown) == 0, ordered).otherwise(shown)).otherwise(found)
    fixed = opps.sparkSession.range(1).select(F.lit("verticals").alias("facet"), F.array(*map(F.lit, VERTICALS)).alias("values"))
    return own.select("facet", found.alias("values")).union(fixed)


def group_counts(rows: DataFrame, column: str, top: int = 12) -> DataFrame:
    """(value, count) of the non-blank values with the largest counts, ties by value."""
    return rows.where(present(column)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(top)


def label_counts(rows: DataFrame, canonical: list[str] = VERTICALS) -> DataFrame:
    """(value, count, place): rows per label in canonical order, without zeros; a row counts under each of its labels."""
    order = F.array(*map(F.lit, canonical))
    counted = rows.select(F.explode(F.array_distinct(labels())).alias("value")).where(F.col("value").isin(canonical)).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("place", F.array_position(order, F.col("value")).cast("int"))


def headline(rows: DataFrame, as_of: datetime.date) -> DataFrame:
    """(total, new_today) of a filtered set."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.to_date("date_scraped") == F.lit(as_of)).alias("new_today"))


def upcoming(rows: DataFrame, as_of: datetime.date, n: int = 8) -> DataFrame:
    return rows.where(F.col("deadline") >= F.lit(as_of)).orderBy("deadline", "id").limit(n)


def cross_source_duplicates(opps: DataFrame, limit: int = 200) -> DataFrame:
    """Titles with one deadline that stand in several sources."""
    found = opps.groupBy("title", "deadline").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_website").alias("sources"))
    return found.where("n > 1 AND sources > 1").orderBy(F.desc("n"), "title", F.asc_nulls_first("deadline")).limit(limit)


def verdicts(rows: DataFrame) -> DataFrame:
    """Counts and shares of link kinds for each source; kinds as columns."""
    out = rows.groupBy("source_website").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("kind") == k).alias(k or "none") for k in ("deep", "listing", "")))
    return out.withColumn("deep_pct", F.round(100 * F.col("deep") / F.col("n"), 1))


def latest_by_key(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The row of each key with the greatest at (null counts as least)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(at).cast("string"), F.lit(""))).alias("x")).select(*keys, "x.*")


def run_counters(pages: DataFrame) -> DataFrame:
    """Per source: pages, items, distinct items and the share that came again."""
    out = pages.groupBy("source").agg(F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("found"), F.countDistinct("item").alias("fresh"))
    return out.withColumn("repeat_pct", F.round(100 * (1 - F.col("fresh") / F.col("found")), 2))


def eta(pages: Column, seconds: Column, pct: Column) -> Column:
    """Seconds to go at the present rate of pages."""
    return F.round((pages / (pages / seconds)) * (100 - pct) / F.greatest(pct, F.lit(1))).cast("long")


def coverage(seen: DataFrame, key: str, total: int) -> DataFrame:
    return seen.agg(F.countDistinct(key).alias("distinct")).withColumn("coverage_pct", F.round(100 * F.col("distinct") / F.lit(total), 2))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
