"""Listings as files for spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links, text

# The columns of an export, in their order, of those that a listing stores; the fingerprint and the resolved link are made.
COLUMNS = ["title", "organization", "country", "region", "funding_type", "vertical", "verticals", "category", "deadline", "website", "opportunity_url", "summary", "location", "eligibility", "funding_amount", "status", "source_website", "date_scraped"]
ORDER = ["unique_id", *COLUMNS[:11], "link", *COLUMNS[11:]]
MARK = "﻿"


def rows(opps: DataFrame) -> DataFrame:
    """The stored columns as text, blank where there is nothing."""
    shown = {"deadline": F.date_format("deadline", "yyyy-MM-dd"), "date_scraped": F.date_format("date_scraped", "yyyy-MM-dd HH:mm:ss")}
    return opps.select(*(F.coalesce(shown.get(c, F.col(c).cast("string")), F.lit("")).alias(c) for c in COLUMNS))


def whole(opps: DataFrame) -> DataFrame:
    """All columns of an export: a link that leads somewhere stands beside the stored one."""
    made = opps.withColumn("unique_id", text.unique_id(F.col("title"), F.col("organization"), F.col("deadline"), F.col("opportunity_url")))
    made = made.withColumn("link", links.resolved(F.col("opportunity_url"), F.col("website"), F.col("source_website"), F.col("title"))["url"])
    plain = {"deadline": F.date_format("deadline", "yyyy-MM-dd"), "date_scraped": F.date_format("date_scraped", "yyyy-MM-dd HH:mm:ss")}
    return made.select(*(F.coalesce(plain.get(c, F.col(c).cast("string")), F.lit("")).alias(c) for c in ORDER))


def write_csv(opps: DataFrame, to: str) -> None:
    """CSV files with a header; the first name carries the mark by which spreadsheets know UTF-8."""
    out = whole(opps)
    marked = out.withColumnRenamed(ORDER[0], MARK + ORDER[0])
    marked.write.option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(to)


def read_csv(spark: SparkSession, at: str) -> DataFrame:
    found = spark.read.option("header", True).option("escape", '"').csv(at).na.fill("")
    return found.withColumnRenamed(MARK + ORDER[0], ORDER[0]).select(*COLUMNS)
