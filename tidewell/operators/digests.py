"""Digest mails: ranked listings rendered as HTML, a row and a section at a time, inside the engine."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from .routing import digest


def escaped(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def row(as_of: datetime.date) -> Column:
    """One listing: linked title, organisation, deadline and how long there is left."""
    deadline = F.when(F.col("deadline").isNull(), "Ongoing").otherwise(F.date_format("deadline", "dd MMM yyyy"))
    cells = F.concat(F.lit('<tr><td><a href="'), escaped(F.coalesce("opportunity_url", F.lit(""))), F.lit('">'), escaped(F.coalesce("title", F.lit(""))), F.lit("</a></td><td>"), escaped(F.coalesce("organization", F.lit(""))))
    return F.concat(cells, F.lit("</td><td>"), deadline, F.lit("</td><td>"), dates.urgency_text(F.col("deadline"), as_of), F.lit("</td></tr>"))


def sections(opps: DataFrame, keys: list[str], heading: str, cap: int, as_of: datetime.date) -> DataFrame:
    """(keys, html): the first cap listings of each group as a table under its heading, and how many more there are."""
    ranked = digest(opps, keys, cap).withColumn("_row", row(as_of))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "_row"))), lambda x: x["_row"])
    found = ranked.groupBy(*keys).agg(F.array_join(ordered, "").alias("_rows"), F.max("hidden").alias("_hidden"))
    more = F.when(F.col("_hidden") > 0, F.concat(F.lit("<p>and "), F.col("_hidden").cast("string"), F.lit(" more</p>"))).otherwise("")
    return found.select(*keys, F.concat(F.lit("<h2>"), escaped(F.col(heading)), F.lit("</h2><table>"), F.col("_rows"), F.lit("</table>"), more).alias("html"))
