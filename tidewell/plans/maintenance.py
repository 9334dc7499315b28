"""Maintenance: idempotent rewrites of columns, each with the number of rows it changed."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, classify, dates, geo, links, organizations, text
from ..functions.lexicons import VERTICAL_PATTERNS


def changed(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Rows that a rewrite changes, as id, and old and new values."""
    out = rows.select("id", *(F.col(c).alias(f"old_{c}") for c in new), *(v.alias(f"new_{c}") for c, v in new.items()))
    differs = None
    for c in new:
        one = ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
        differs = one if differs is None else differs | one
    return out.where(differs)


def rewritten(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    return rows.withColumns(new)


def verticals(lexicon: dict[str, list[str]] = VERTICAL_PATTERNS) -> dict[str, Column]:
    body = text.body(F.col("summary"), F.col("vertical"), F.col("eligibility"))
    return {"verticals": text.joined(classify.verticals(F.col("title"), body, lexicon))}


def geography(places: geo.Places) -> dict[str, Column]:
    """From the location first, then the country; an old region stays where none is derived."""
    a, b = geo.normalised(F.col("location"), F.lit(""), places), geo.normalised(F.col("country"), F.lit(""), places)
    country = F.when(a["country"] != "", a["country"]).otherwise(b["country"])
    region = F.coalesce(F.nullif(F.when(a["country"] != "", a["region"]).otherwise(b["region"]), F.lit("")), F.col("region"))
    return {"country": country, "region": region}


def organization() -> dict[str, Column]:
    old = text.blank(F.col("organization"))
    return {"organization": F.when(text.numeric_only(old), "").when(old == "", organizations.extracted(F.col("summary"), F.col("title"))).otherwise(F.col("organization"))}


def amount() -> dict[str, Column]:
    return {"funding_amount": F.coalesce(F.nullif(amounts.cleaned(F.col("funding_amount")), F.lit("")), amounts.extracted(F.col("summary"), F.col("title")))}


def work_type() -> dict[str, Column]:
    return {"work_type": classify.work_type(F.col("title"), text.body(F.col("summary"), F.col("eligibility"), F.col("vertical")))}


def study_type() -> dict[str, Column]:
    """Blanks only, from title and summary."""
    return {"study_type": F.when(F.col("study_type") == "", classify.study_type(F.col("title"), F.col("summary"))).otherwise(F.col("study_type"))}


def link() -> dict[str, Column]:
    return {"opportunity_url": links.repaired(F.col("opportunity_url"), F.col("website"))}


def deadline(rows: DataFrame, as_of: datetime.date) -> DataFrame:
    """(sentinels_cleared, expired, reactivated): what the audit changes."""
    new = dates.audited(rows.withColumn("_status", F.col("status")).withColumn("_deadline", F.col("deadline")), as_of)
    return new.agg(
        F.count_if(F.col("_deadline").isNotNull() & F.col("deadline").isNull()).alias("sentinels_cleared"),
        F.count_if((F.col("_status") != F.col("status")) & (F.col("status") == "Expired")).alias("expired"),
        F.count_if((F.col("_status") != F.col("status")) & (F.col("status") == "Active")).alias("reactivated"),
    )


def purged(rows: DataFrame, bad: Callable[[], Column] | Column) -> DataFrame:
    test = bad() if callable(bad) else bad
    return rows.where(~F.coalesce(test, F.lit(False)))


def renamed_sources(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old source names to new ones; others stay."""
    mapping = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return rows.withColumn("source_website", F.coalesce(F.try_element_at(mapping, F.col("source_website")), F.col("source_website")))


def migrated(rows: DataFrame, add: dict[str, Column], rename: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed, and added with a default where they are missing."""
    out = rows
    for old, new in (rename or {}).items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    return out.withColumns({c: v for c, v in add.items() if c not in out.columns})
