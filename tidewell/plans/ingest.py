"""Ingest: raw listings to new canonical rows, as one lazy chain, with a counter for every rule."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENABLED_CATEGORIES
from ..functions import amounts, classify, dates, geo, links, organizations, text
from ..functions.lexicons import CATEGORY_PATTERNS, VERTICAL_PATTERNS
from ..functions.places import WORLD

RAW = "title string, organization string, country string, region string, funding_type string, vertical string, category_hint string, deadline_raw string, website string, opportunity_url string, summary string, location string, eligibility string, funding_amount string, source_website string, dayfirst boolean, assume_active boolean"


@dataclass
class Rules:
    """What a run keeps."""

    as_of: datetime.date
    keep_expired: bool = False
    wanted_verticals: list[str] = field(default_factory=list)
    places: geo.Places = field(default_factory=lambda: WORLD)
    categories: dict[str, list[str]] = field(default_factory=lambda: CATEGORY_PATTERNS)
    verticals: dict[str, list[str]] = field(default_factory=lambda: VERTICAL_PATTERNS)
    enabled: list[str] = field(default_factory=lambda: ENABLED_CATEGORIES)
    sentinel_is_ongoing: bool = False


def dated(raw: DataFrame, rules: Rules) -> DataFrame:
    """Raw rows with deadline, status and unique_id, and the flags of rules that need no classification.

    A sentinel deadline becomes null, yet the row is only ongoing if its text or source says so
    (or the rules do). unique_id is over what the source wrote, before columns are cleaned.
    """
    rows = dates.with_deadline(raw, "deadline_raw", rules.as_of)
    odd = dates.sentinel(F.col("deadline"), rules.as_of)
    open_end = dates.ongoing(F.col("deadline_raw")) | F.coalesce("assume_active", F.lit(False))
    if rules.sentinel_is_ongoing:
        open_end = open_end | odd
    rows = rows.withColumn("_ongoing", F.when(odd | F.col("deadline").isNull(), open_end).otherwise(False)).withColumn("deadline", F.when(~odd, F.col("deadline")))
    rows = rows.withColumn("status", dates.status(F.col("deadline"), F.col("_ongoing"), rules.as_of))
    rows = rows.withColumn("unique_id", text.unique_id(F.col("title"), F.col("organization"), F.col("deadline"), F.col("opportunity_url")))
    return rows.withColumn("is_expired", F.col("status") == "Expired").withColumn("is_spam", text.spam(F.col("title"), F.col("summary"))).drop("_ongoing")


def described(rows: DataFrame, rules: Rules) -> DataFrame:
    """Dated rows with what their texts tell (category, labels, kinds of work, place, organisation, amount), and whether their labels are wanted."""
    rows = rows.withColumn("_body", text.body(F.col("summary"), F.col("vertical"), F.col("eligibility")))
    lists = classify.every_list(rules.categories, rules.enabled, rules.verticals)
    rows = rows.withColumn("_seen", classify.Evidence(lists, F.col("title"), F.col("_body")).column)
    seen, judge = classify.Evidence(lists, F.col("_seen")), (F.col("title"), F.col("_body"))
    rows = rows.withColumn("category", classify.category(*judge, F.col("category_hint"), rules.categories, rules.enabled, seen))
    rows = rows.withColumn("labels", classify.verticals(*judge, rules.verticals, seen=seen))
    rows = rows.withColumn("work_type", classify.work_type(*judge, seen=seen)).withColumn("study_type", classify.study_type(*judge, seen=seen))
    rows = rows.withColumn("_place", geo.normalised(F.col("country"), F.col("region"), rules.places)).withColumn("country", F.col("_place.country")).withColumn("region", F.col("_place.region"))
    named = organizations.tidied(F.col("organization"))
    rows = rows.withColumn("organization", F.when(text.blank(F.col("organization")) != "", named).otherwise(organizations.extracted(F.col("summary"), F.col("title"))))
    rows = rows.withColumn("funding_amount", F.coalesce(F.nullif(amounts.cleaned(F.col("funding_amount")), F.lit("")), amounts.extracted(F.col("summary"), F.col("title"))))
    rows = rows.withColumn("opportunity_url", links.canonical(F.col("opportunity_url")))
    wanted = _wanted(rules)
    off = ~F.arrays_overlap("labels", F.array(*map(F.lit, wanted))) if wanted else F.lit(False)
    return rows.withColumn("off_vertical", off).withColumn("verticals", text.joined(F.col("labels"))).drop("_body", "_place", "_seen", "labels")


def _wanted(rules: Rules) -> list[str]:
    return [x for x in rules.wanted_verticals if x in rules.verticals]


def judged(raw: DataFrame, rules: Rules) -> DataFrame:
    """Raw rows with all derived columns and a flag for each reason to drop a row."""
    return described(dated(raw, rules), rules)


def accepted(rows: DataFrame, rules: Rules) -> DataFrame:
    keep = ~F.col("off_vertical") & ~F.col("is_spam")
    if not rules.keep_expired:
        keep = keep & ~F.col("is_expired")
    # a column that is not the same twice keeps the tests above what they test: pushed below, they would work out each deadline again
    return rows.withColumn("_at", F.monotonically_increasing_id()).where(keep & (F.col("_at") >= 0)).drop("is_expired", "off_vertical", "is_spam", "_at")


def counters(rows: DataFrame) -> DataFrame:
    """Per source; a row can count under several rules."""
    return rows.groupBy("source_website").agg(F.count(F.lit(1)).alias("found"), *(F.count_if(x).alias(x) for x in ("is_expired", "off_vertical", "is_spam")))


def first_of_each(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each unique_id in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("unique_id").orderBy(*order))).where("_n = 1").drop("_n")


def only_new(rows: DataFrame, table: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each unique_id in order, unless the table has it."""
    first = first_of_each(rows, order)
    return first.join(table.select("unique_id"), "unique_id", "left_anti")


def ingested(raw: DataFrame, table: DataFrame, rules: Rules, order: list[str]) -> DataFrame:
    """The new rows of a batch, from raw listings to what is inserted: judged, filtered, first seen and not in the table."""
    return only_new(accepted(judged(raw, rules), rules), table, order)


def fresh(raw: DataFrame, rules: Rules, order: list[str], unseen: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first row of each unique_id in order among the accepted ones, judged, where unseen leaves it.

    Unless labels decide what is accepted, texts are only classified of rows that are left: not of
    what is over, comes twice or is known.
    """
    if _wanted(rules):
        return unseen(first_of_each(accepted(judged(raw, rules), rules), order))
    left = accepted(dated(raw, rules).withColumn("off_vertical", F.lit(False)), rules)
    return described(unseen(first_of_each(left, order)), rules).drop("off_vertical")


def merged(table: DataFrame, incoming: DataFrame, active_only: bool = False) -> DataFrame:
    """The table with incoming rows of new unique_ids, over the columns that both have."""
    shared = [c for c in table.columns if c in incoming.columns and c != "id"]
    new = incoming.where("status = 'Active'") if active_only else incoming
    return table.select(shared).unionByName(new.select(shared).dropDuplicates(["unique_id"]).join(table.select("unique_id"), "unique_id", "left_anti"))


def approve(table: DataFrame, ids: list[int], who: str, at: datetime.datetime, on: bool = True) -> DataFrame:
    """Marks rows; the first approval keeps its name and time, taking it back clears both."""
    hit = F.col("id").isin(ids)
    first = hit & ~F.coalesce("approved", F.lit(False))
    out = table
    for name, value in (("approved_at", F.lit(at)), ("approved_by", F.lit(who))):
        out = out.withColumn(name, F.when(first, value).otherwise(F.col(name)) if on else F.when(~hit, F.col(name)))
    return out.withColumn("approved", F.when(hit, F.lit(on)).otherwise(F.col("approved")))
