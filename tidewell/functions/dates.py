"""Deadlines: parsing, ongoing markers, sentinels, status, urgency, schedules."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SENTINEL_DAYS, SENTINELS
from .text import blank

# Markers of calls without an end, labels in front of a date, shapes of a date.
ONGOING = r"(?i)\b(ongoing|rolling(\s+basis)?|open[\s-]?ended|no\s+(fixed\s+)?deadline|always\s+open|until\s+filled|continuous)\b"
DATE_LABELS = r"(?i)(deadline|apply by|last date|closing date|closes?( on)?|due( date| by)?|submission( date)?|apply before|on or before)\s*[:\-–]?\s*"
DATE_SHAPES = r"(?i)(\d{1,2}[\s./\-]\w{3,9}[\s./\-,]+\d{2,4})|(\w{3,9}[\s./\-]\d{1,2}(st|nd|rd|th)?[\s,./\-]+\d{2,4})|(\d{4}-\d{2}-\d{2})|(\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4})"
#: Formats that read one way only; tried in generated code before anything else.
PLAIN_FORMATS = ("d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "d-MMM-yyyy")
DAY_FIRST, MONTH_FIRST = ("d/M/yyyy", "d.M.yyyy", "d-M-yyyy"), ("M/d/yyyy", "M.d.yyyy", "M-d-yyyy")


def stripped(raw: Column) -> Column:
    text = F.regexp_replace(F.trim(blank(raw)), DATE_LABELS, "")
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(text, r"(?i)(\d{1,2})(st|nd|rd|th)\b", "$1"), F.lit(","), F.lit(" ")), r"\s+", " "))


def plain_date(raw: Column, dayfirst: bool = True) -> Column:
    """A deadline in one of the common formats, else null."""
    text = stripped(raw)
    formats = (*PLAIN_FORMATS, *(DAY_FIRST if dayfirst else MONTH_FIRST))
    return F.coalesce(*(F.try_to_date(text, f) for f in formats))


def fuzzy_parser(as_of: datetime.date, dayfirst: bool = True):
    """A vectorised parser of free text; what a text leaves out is taken from as_of.

    ISO dates are read day first too, as everything else, when dayfirst is set.
    """
    default = datetime.datetime.combine(as_of, datetime.time())

    @F.pandas_udf("date")
    def parse(texts: pd.Series) -> pd.Series:
        import re

        from dateutil import parser

        def one(text):
            for candidate in (text, m.group(0) if (m := re.search(DATE_SHAPES, text or "")) else None):
                if candidate and candidate.strip():
                    try:
                        return parser.parse(candidate, dayfirst=dayfirst, fuzzy=True, default=default).date()
                    except (ValueError, OverflowError):
                        continue
            return None

        known = {text: one(text) for text in texts.dropna().unique()}
        return texts.map(known.get)

    return parse


def with_deadline(rows: DataFrame, raw: str, as_of: datetime.date, dayfirst: bool = True, to: str = "deadline") -> DataFrame:
    """Adds the deadline: common formats in generated code; only what is left is handed to the parser, each text once a batch."""
    quick = rows.withColumn("_text", stripped(F.col(raw))).withColumn(to, plain_date(F.col(raw), dayfirst))
    left = F.when(F.col(to).isNull() & F.col("_text").rlike(r"\d|[A-Za-z]{3}"), F.col("_text"))
    return quick.withColumn(to, F.coalesce(to, fuzzy_parser(as_of, dayfirst)(left))).drop("_text")


def ongoing(raw: Column) -> Column:
    return blank(raw).rlike(ONGOING)


def is_active(deadline: Column, as_of: datetime.date) -> Column:
    return F.coalesce(deadline >= F.lit(as_of), F.lit(False))


def sentinel(deadline: Column, as_of: datetime.date) -> Column:
    return F.coalesce(deadline.isin([F.to_date(F.lit(d.isoformat())) for d in SENTINELS]) | (deadline > F.lit(as_of + datetime.timedelta(days=SENTINEL_DAYS))), F.lit(False))


def status(deadline: Column, is_ongoing: Column, as_of: datetime.date) -> Column:
    return F.when(is_active(deadline, as_of) | (deadline.isNull() & is_ongoing), "Active").otherwise("Expired")


def audited(rows: DataFrame, as_of: datetime.date) -> DataFrame:
    """Deadlines without sentinels; status re-derived wherever a deadline is left."""
    cleared = rows.withColumn("deadline", F.when(~sentinel(F.col("deadline"), as_of), F.col("deadline")))
    fresh = F.when(F.col("deadline") < F.lit(as_of), "Expired").otherwise("Active")
    return cleared.withColumn("status", F.when(F.col("deadline").isNotNull(), fresh).otherwise(F.col("status")))


def days_left(deadline: Column, as_of: datetime.date) -> Column:
    return F.greatest(F.lit(0), F.datediff(deadline, F.lit(as_of)))


def urgency(deadline: Column, as_of: datetime.date) -> Column:
    left = F.datediff(deadline, F.lit(as_of))
    return F.when(deadline.isNull(), "none").when(left <= 3, "red").when(left <= 7, "orange").when(left <= 14, "amber").otherwise("grey")


def urgency_text(deadline: Column, as_of: datetime.date) -> Column:
    left = F.datediff(deadline, F.lit(as_of))
    return F.when(deadline.isNull(), "Ongoing").when(left == 0, "closes today").when(left > 0, F.concat(left.cast("string"), F.lit(" days left"))).otherwise("closed")


def duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("int")
    return F.when(whole < 60, F.format_string("%ds", whole)).otherwise(F.format_string("%dm %ds", F.floor(whole / 60).cast("int"), (whole % 60).cast("int")))


def reminder_date(as_of: datetime.date, days: Column) -> Column:
    """The deadline that a reminder so many days ahead is about."""
    return F.date_add(F.lit(as_of), days)


def due(kind: Column, last: Column, now: Column) -> Column:
    """Whether a schedule (manual, daily, weekly on Monday, monthly on the 1st, yearly on 1 January) has a run outstanding."""
    start = F.when(kind == "daily", F.date_trunc("day", now)).when(kind == "weekly", F.date_trunc("week", now)).when(kind == "monthly", F.date_trunc("month", now)).when(kind == "yearly", F.date_trunc("year", now))
    return F.coalesce(start.isNotNull() & (last.isNull() | (last < start)), F.lit(False))


def reminder_days(days: Column, fallback: tuple[int, ...]) -> Column:
    kept = F.sort_array(F.array_distinct(F.filter(days, lambda d: d.between(1, 90))), asc=False)
    return F.when(F.size(kept) == 0, F.array(*map(F.lit, fallback))).otherwise(kept)


def is_due(kind: str, last: datetime.datetime | None, now: datetime.datetime) -> bool:
    """Whether a schedule (manual, daily, weekly on Monday, monthly on the 1st, yearly on 1 January) has a run outstanding."""
    if kind == "manual":
        return False
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    start = {"daily": day, "weekly": day - datetime.timedelta(days=day.weekday()), "monthly": day.replace(day=1), "yearly": day.replace(month=1, day=1)}[kind]
    return last is None or last < start
