"""When a crawl of a source ends: the same request again, a page without items, too many pages with nothing new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.routing import stale_cut


def until_repeat(requests: DataFrame, source: str, request: Column, order: str) -> DataFrame:
    """Requests (method, URL and body make one) up to the first that a source has sent before."""
    seen = requests.withColumn("_n", F.row_number().over(Window.partitionBy(source, request).orderBy(order)))
    ends = seen.where("_n = 2").groupBy(F.col(source).alias("_source")).agg(F.min(order).alias("_end"))
    kept = seen.join(ends, F.col(source).eqNullSafe(F.col("_source")), "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    return kept.drop("_n", "_source", "_end")


def until_empty(pages: DataFrame, source: str = "source", page: str = "page", found: str = "found") -> DataFrame:
    """Pages of every source before its first page without items."""
    ends = pages.where(F.col(found) == 0).groupBy(F.col(source).alias("_source")).agg(F.min(page).alias("_end"))
    kept = pages.join(ends, F.col(source).eqNullSafe(F.col("_source")), "left").where(F.col("_end").isNull() | (F.col(page) < F.col("_end")))
    return kept.drop("_source", "_end")


def fresh_pages(items: DataFrame, limit: int) -> DataFrame:
    """(source, page, found, saved, streak) of items (source, page, item), cut after limit pages in a row that bring nothing new."""
    first = items.groupBy("source", "item").agg(F.min("page").alias("page"))
    saved = first.groupBy("source", "page").agg(F.count(F.lit(1)).alias("saved"))
    pages = items.groupBy("source", "page").agg(F.count(F.lit(1)).alias("found")).join(saved, ["source", "page"], "left").fillna(0, ["saved"])
    return stale_cut(pages, limit)
