"""Distinct items of a crawl by stored sketches that merge: a source's repeats without reading its pages again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Twice the logarithm of a sketch's registers: a relative standard error of about 1.04 / 2 ** (bits / 2), 1.6 % here.
BITS = 12


def page_sketches(items: DataFrame, bits: int = BITS) -> DataFrame:
    """(source, page, found, sketch) of items (source, page, item): what is stored of each page."""
    return items.groupBy("source", "page").agg(F.count(F.lit(1)).alias("found"), F.hll_sketch_agg("item", bits).alias("sketch"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """(by..., pages, found, fresh) of stored sketches: fresh is how many items are distinct, about."""
    whole = sketches.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.sum("found").alias("found"), F.hll_union_agg("sketch").alias("sketch"))
    return whole.select(*by, "pages", "found", F.hll_sketch_estimate("sketch").alias("fresh"))


def repeats(sketches: DataFrame) -> DataFrame:
    """(source, pages, found, fresh, repeat_pct) of each source, from what is stored of its pages."""
    return merged(sketches, "source").withColumn("repeat_pct", F.greatest(F.lit(0.0), F.round(100 * (1 - F.col("fresh") / F.col("found")), 2)))


def coverage(sketches: DataFrame, totals: DataFrame) -> DataFrame:
    """(source, fresh, coverage_pct): the share of what a source says it has (totals: source, total) that has been seen, about."""
    return merged(sketches, "source").join(totals, "source").select("source", "fresh", F.least(F.lit(100.0), F.round(100 * F.col("fresh") / F.col("total"), 2)).alias("coverage_pct"))
