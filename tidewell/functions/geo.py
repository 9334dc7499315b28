"""Countries and regions: one canonical pair from what a source wrote.

Names and aliases are a table, given as parameters: ``Places`` holds maps that a deployment
fills from its own files; ``places_of`` derives one from any (country, region) table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank

# Words that mark a value as no place, and what separates several places.
NOT_PLACES = (
    r"(?i)^(round|cycle|phase|edition|batch|call|window|tranche|stage|series|cohort|wave|intake|version)\b"
    r"|^\d+(st|nd|rd|th)?\s+(round|cycle|phase|edition|batch|call|cohort|window|wave|intake|tranche)\b"
    r"|^(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+(round|cycle|phase|edition|cohort|window)\b"
    r"|[$€£₹¥]|\b(usd|eur|gbp|inr|chf|aud|cad|nzd|zar|sek|nok|dkk|jpy)\b"
    r"|^\d{4}(\s*[-–/]\s*\d{2,4})?$|^\d+\s*(k|m|bn|million|billion|lakh|crore)\b|^up\s+to\b|^from\b|^under\b|^over\b"
)
SEPARATORS = r"(?i)\s*(?:,|;|/|\||&|–|—|\band\b|\bwith\b|\bor\b)\s*"
MAX_PAIRS = 10_000


@dataclass
class Places:
    """Maps with lower-case keys."""

    country: dict[str, str] = field(default_factory=dict)  # any spelling -> name
    region: dict[str, str] = field(default_factory=dict)  # country name, lower case -> region
    scope: dict[str, str] = field(default_factory=dict)  # names of regions -> region


def places_of(rows: DataFrame, aliases: dict[str, str] | None = None, scopes: dict[str, str] | None = None) -> Places:
    """Places from a small table (country, region): a dimension of some hundred rows, an error beyond MAX_PAIRS."""
    pairs = rows.select("country", "region").distinct().limit(MAX_PAIRS + 1).collect()
    if len(pairs) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of country and region: no dimension of places")
    names = {c.lower(): c for c, _ in pairs} | {k.lower(): v for k, v in (aliases or {}).items()}
    return Places(names, {c.lower(): r for c, r in pairs}, {r.lower(): r for _, r in pairs} | {k.lower(): v for k, v in (scopes or {}).items()})


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv)) if values else F.create_map(F.lit(""), F.lit(""))


def canonical_country(x: Column, places: Places) -> Column:
    """The name of a listed country, else blank."""
    v = F.regexp_replace(F.trim(blank(x)), r"^[\s.,;:\-–—()\[\]]+|[\s.,;:\-–—()\[\]]+$", "")
    return F.when((v == "") | v.rlike(NOT_PLACES), "").otherwise(F.coalesce(F.try_element_at(_map(places.country), F.lower(v)), F.lit("")))


def region_of(country: Column, places: Places) -> Column:
    return F.coalesce(F.try_element_at(_map(places.region), F.lower(F.trim(blank(country)))), F.lit(""))


def normalised(country: Column, region: Column, places: Places) -> Column:
    """struct(country, region).

    The name of a region in the country column moves over; of several countries the first one
    with a region counts; a region that was given is kept; otherwise it comes from the country,
    and only then from a region named beside it.
    """
    raw = F.trim(blank(country))
    scope = lambda c: F.try_element_at(_map(places.scope), F.lower(F.trim(c)))
    given = F.coalesce(scope(region), F.trim(blank(region)))
    whole = canonical_country(raw, places)
    parts = F.filter(F.split(raw, SEPARATORS), lambda p: F.trim(p) != "")
    named = F.filter(F.transform(F.filter(parts, lambda p: scope(p).isNull()), lambda p: canonical_country(p, places)), lambda c: c != "")
    placed = F.filter(named, lambda c: region_of(c, places) != "")
    scoped = F.filter(F.transform(parts, scope), lambda r: r.isNotNull())
    first = lambda a: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))
    one = F.when(whole != "", whole).when(F.size(placed) > 0, first(placed)).otherwise(first(named))
    is_scope = scope(raw).isNotNull()
    name = F.when((raw == "") | is_scope, "").otherwise(one)
    fallback = F.when(raw == "", "").when(is_scope, scope(raw)).when(region_of(name, places) != "", region_of(name, places)).when(whole != "", "").otherwise(first(scoped))
    return F.struct(name.alias("country"), F.when(given != "", given).otherwise(fallback).alias("region"))


def looked_up(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows with the other columns of the place (country, ...) that their country names; places is a dimension, broadcast when small."""
    known = places.groupBy(F.upper(F.trim("country")).alias("_key")).agg(*(F.min(c).alias(c) for c in places.columns if c != "country"))
    return rows.withColumn("_key", F.upper(F.trim(blank(F.col("country"))))).join(known, "_key", "left").drop("_key")


def display_case(x: Column) -> Column:
    """Names in title case, small words lower, parts of hyphenated names capitalised."""
    small = ["and", "of", "the", "da", "del", "de", "des", "du"]
    word = lambda w, i: F.when(w.contains("."), F.upper(w)).when(w.isin(small) & (i > 0), w).when(w.contains("-"), F.array_join(F.transform(F.split(w, "-"), lambda p: F.initcap(p)), "-")).otherwise(F.initcap(w))
    return F.array_join(F.transform(F.split(F.lower(F.trim(blank(x))), r"\s+"), word), " ")
