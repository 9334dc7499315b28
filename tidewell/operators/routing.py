"""Who gets what: matching members, ledgers, ranked digests and reminders.

All keywords and labels that members want are looked for in each listing in one pass; listings meet
members on the words they hold, or else on categories, by equal keys. More terms than TERM_BLOCK
are held against listings by a join (``functions.grams``). Members are broadcast when
counted below ``MEMBER_LIMIT``; beyond, only ids and keys are shuffled.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CAP_LADDER, CATEGORIES, DIGEST_BUDGET
from ..functions.grams import with_terms
from .filters import active, labels

MEMBER_LIMIT = 1_000
TERM_BLOCK = 50_000
#: Tasks over which listings are dealt that meet members by category alone.
SHARES = 16
MATCHED = ("title", "organization", "summary", "vertical")


def wanted(column: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def matches(opps: DataFrame, members: DataFrame, as_of: datetime.date, block: int = TERM_BLOCK) -> DataFrame:
    """(member_id, id, ...) of active listings that meet a member's keywords, categories and labels.

    An empty list doesn't restrict; neither do categories that are all unknown.
    """
    known = F.array(*map(F.lit, CATEGORIES))
    low = lambda column: F.array_distinct(F.transform(wanted(column), lambda x: F.lower(x)))
    people = members.select("member_id", low("keywords").alias("kw"), F.array_intersect(wanted("categories"), known).alias("cats"), low("verticals").alias("verts"))
    rows = opps.where(active(as_of))
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    head = people.select("kw", "verts").limit(MEMBER_LIMIT + 1).collect()
    few = len(head) <= MEMBER_LIMIT
    asked = lambda column: [x for r in head for x in r[column]] if few else people.select(F.explode(column).alias("term"))
    heard = with_terms(rows if few else rows.select("id", "category", "verticals", *MATCHED), "_kw", asked("kw"), *map(text, MATCHED), block=block)
    heard = with_terms(heard, "_verts", asked("verts"), text("verticals"), block=block).withColumn("_verts", F.array_distinct(F.concat("_verts", F.array(text("vertical")))))
    marked = lambda mark, x: F.transform(x, lambda k: F.concat(F.lit(mark), k))
    # a member goes by keywords, else by labels, else by categories, else meets all: the last two are dealt over SHARES
    shares = lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SHARES - 1)), lambda i: marked("c", F.transform(x, lambda k: F.concat(i.cast("string"), F.lit(" "), k)))))
    keys = F.when(F.size("kw") > 0, marked("k", F.col("kw"))).when(F.size("verts") > 0, marked("v", F.col("verts"))).otherwise(shares(F.when(F.size("cats") > 0, F.col("cats")).otherwise(F.array(F.lit("")))))
    people = people.withColumn("_key", F.explode(keys))
    share = F.concat(F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("string"), F.lit(" "))
    own = F.concat(marked("k", F.col("_kw")), marked("v", F.col("_verts")), F.array_compact(F.array(F.concat(F.lit("c"), share), F.concat(F.lit("c"), share, "category"))))
    sides = heard if few else heard.select("id", "category", "_kw", "_verts")
    met = sides.withColumn("_key", F.explode(F.array_distinct(own))).join(F.broadcast(people) if few else people, "_key")
    fits = ((F.size("kw") == 0) | F.arrays_overlap("kw", "_kw")) & ((F.size("cats") == 0) | F.array_contains("cats", F.col("category"))) & ((F.size("verts") == 0) | F.arrays_overlap("verts", "_verts"))
    # of several keys that a listing shares with a member the first counts
    first = F.when(F.size("kw") > 0, F.concat(F.lit("k"), F.get(F.array_intersect("kw", "_kw"), F.lit(0)))).when(F.size("verts") > 0, F.concat(F.lit("v"), F.get(F.array_intersect("verts", "_verts"), F.lit(0)))).otherwise(F.col("_key"))
    met = met.where(fits & (F.col("_key") == first))
    return met.drop("_key", "_kw", "_verts", "kw", "cats", "verts") if few else met.select("member_id", "id").join(rows, "id")


def members_merged(members: DataFrame, other: DataFrame) -> DataFrame:
    """The members with those of another store (email, ...) whose address they lack, each address once."""
    new = other.dropDuplicates(["email"]).join(members.select("email"), "email", "left_anti")
    return members.unionByName(new)


def members_upserted(members: DataFrame, changed: DataFrame, left: DataFrame, logins: DataFrame) -> DataFrame:
    """Members (member_id, email, ...) with changed rows in place of theirs, without those who left, and with a row for each first login of an unknown address."""
    kept = members.join(left.select("member_id"), "member_id", "left_anti")
    now = kept.join(changed.select("member_id"), "member_id", "left_anti").unionByName(changed.join(kept.select("member_id"), "member_id", "left_semi"))
    return now.unionByName(logins.dropDuplicates(["email"]).join(now.select("email"), "email", "left_anti"))


def unsent(matched: DataFrame, sent: DataFrame) -> DataFrame:
    return matched.join(sent.select("member_id", F.col("opportunity_id").alias("id")), ["member_id", "id"], "left_anti")


def log_sent(sent: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with new deliveries: one row for each member and listing, the latest time."""
    return sent.unionByName(new).groupBy("member_id", "opportunity_id").agg(F.max("sent_at").alias("sent_at"))


def due_reminders(opps: DataFrame, members: DataFrame, sent: DataFrame, as_of: datetime.date, days: list[int], reminded: DataFrame | None = None) -> DataFrame:
    """(member_id, id, days_before, deadline) of what was sent and ends in so many days, unless reminded of."""
    ending = opps.where(F.col("status") == "Active").where(F.col("deadline").isin([as_of + datetime.timedelta(d) for d in days])).select("id", "deadline", "title")
    ending = ending.withColumn("days_before", F.datediff("deadline", F.lit(as_of)).cast("int"))
    people = members.where("active").select("member_id")
    due = sent.select("member_id", F.col("opportunity_id").alias("id")).join(ending, "id").join(people, "member_id", "left_semi")
    if reminded is not None:
        due = due.join(reminded.select("member_id", F.col("opportunity_id").alias("id"), "days_before"), ["member_id", "id", "days_before"], "left_anti")
    return due.select("member_id", "id", "days_before", "deadline")


def region_rank(column: str, order: list[str]) -> Column:
    """Listed regions in their order, then others, blanks last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", 2).when(at == 0, 1).otherwise(0) * 10_000 + at


def digest(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """The first cap rows of each group by deadline, with how many the group hides."""
    own = Window.partitionBy(*keys)
    ranked = rows.withColumn("place", F.row_number().over(own.orderBy(F.col("deadline").asc_nulls_last(), "id")))
    return ranked.withColumn("hidden", F.greatest(F.count(F.lit(1)).over(own) - cap, F.lit(0))).where(F.col("place") <= cap)


def fitting_cap(rows: DataFrame, by: str, row_size: Column, ladder=CAP_LADDER, budget: int = DIGEST_BUDGET, overhead: int = 0) -> DataFrame:
    """(member_id, cap): the first cap of the ladder whose digest fits the budget, else the last."""
    own = Window.partitionBy("member_id", by).orderBy(F.col("deadline").asc_nulls_last(), "id")
    placed = rows.withColumn("_size", row_size).withColumn("_place", F.row_number().over(own))
    sizes = placed.groupBy("member_id").agg(*(F.sum(F.when(F.col("_place") <= c, F.col("_size")).otherwise(0)).alias(f"s{c}") for c in ladder))
    cap = F.coalesce(*(F.when(F.col(f"s{c}") + overhead <= budget, c) for c in ladder), F.lit(ladder[-1]))
    return sizes.select("member_id", cap.cast("int").alias("cap"))


def pick_in_order(opps: DataFrame, ids: list[int]) -> DataFrame:
    """The listings of a hand-picked list, in its order; ids that don't exist come with null columns."""
    spark = opps.sparkSession
    asked = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id long, pos int")
    return asked.join(opps, "id", "left").orderBy("pos")


def stale_cut(pages: DataFrame, limit: int) -> DataFrame:
    """Pages (source, page, found, saved) up to where a source has had limit full pages in a row with nothing new.

    An empty page ends a streak, as does one with something new. limit 0 never stops.
    """
    if not limit:
        return pages.withColumn("streak", F.lit(0))
    order = Window.partitionBy("source").orderBy("page")
    stale = (F.col("found") > 0) & (F.col("saved") == 0)
    part = pages.withColumn("_stale", stale).withColumn("_group", F.sum(F.when(F.col("_stale"), 0).otherwise(1)).over(order))
    run = part.withColumn("streak", F.sum(F.col("_stale").cast("int")).over(Window.partitionBy("source", "_group").orderBy("page")))
    ended = F.coalesce(F.max((F.col("streak") >= limit).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return run.withColumn("_over", ended).where("_over = 0").drop("_stale", "_group", "_over")


def with_labels(opps: DataFrame) -> DataFrame:
    return opps.withColumn("labels", labels())
