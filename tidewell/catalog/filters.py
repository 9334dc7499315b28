"""Scans, scopes, predicates, projections, sorting, paging and set operations."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..config import AS_OF
from ..fixtures import index, opportunities, sql
from ..operators import filters as op
from ..operators import search_index
from ..operators.filters import Listing
from ..registry import query
from ..sources import planning

ACTIVE = "status = 'Active' AND (deadline >= DATE '1998-08-02' OR deadline IS NULL)"
SHOWN = f"{ACTIVE} AND verticals <> ''"
BRIEF = ["id", "title", "deadline", "country", "category"]
EVERYTHING = Listing(english_only=False, classified_only=False)


def _ids(name: str, test, where: str):
    query(name, sql(f"SELECT id FROM opportunities WHERE {where}"))(lambda spark, d: opportunities(spark, d).where(test()).select("id"))


def _listing(name: str, q: Listing, where: str):
    query(name, sql(f"SELECT id FROM opportunities WHERE {where}"))(lambda spark, d: op.filtered(opportunities(spark, d), q, AS_OF).select("id"))


@query("src_01_table_scan", sql("SELECT id, title, organization, country, region, category, deadline, status FROM opportunities"))
def table_scan(spark, d):
    return opportunities(spark, d).select("id", "title", "organization", "country", "region", "category", "deadline", "status")


@query("src_02_backfill_scan", sql("SELECT id, title, summary, eligibility, vertical FROM opportunities"))
def backfill_scan(spark, d):
    return opportunities(spark, d).select("id", "title", "summary", "eligibility", "vertical")


_ids("flt_01_active_scope", lambda: op.active(AS_OF), ACTIVE)
_listing("flt_02_archive_scope", Listing(archived=True, english_only=False, classified_only=False), "status = 'Expired'")
_listing("flt_03_approved_scope", Listing(approved=True, archived=True, english_only=False, classified_only=False), "approved")
_listing("flt_04_new_today", Listing(new_today=True, english_only=False, classified_only=False), f"{ACTIVE} AND CAST(date_scraped AS DATE) = DATE '1998-08-02'")
_listing("flt_05_work_and_study_type", Listing(work_type="Research", study_type="Baseline", english_only=False, classified_only=False), f"{ACTIVE} AND work_type = 'Research' AND study_type = 'Baseline'")
_listing("flt_06_english_only", Listing(classified_only=False), ACTIVE)
_listing("flt_07_classified_only", Listing(english_only=False), SHOWN)
_listing("flt_08_category_in", Listing(category=["Grant", "RFP"], english_only=False, classified_only=False), f"{ACTIVE} AND category IN ('Grant', 'RFP')")
_listing("flt_09_any_label", Listing(verticals=["climate", "Economy"], english_only=False, classified_only=False), f"{ACTIVE} AND (contains(lower(verticals), 'climate') OR lower(vertical) = 'climate' OR contains(lower(verticals), 'economy') OR lower(vertical) = 'economy')")
_listing("flt_10_fields_in", Listing(region=["ASIA", "EUROPE"], source_website=["BUILDING", "MACHINERY"], country=["NATION_2", "NATION_3", "NATION_7"], english_only=False, classified_only=False), f"{ACTIVE} AND region IN ('ASIA', 'EUROPE') AND source_website IN ('BUILDING', 'MACHINERY') AND country IN ('NATION_2', 'NATION_3', 'NATION_7')")
_listing("flt_11_deadline_range", Listing(deadline_after=datetime.date(1999, 1, 1), deadline_before=datetime.date(1999, 3, 31), english_only=False, classified_only=False), f"{ACTIVE} AND deadline BETWEEN DATE '1999-01-01' AND DATE '1999-03-31'")
_STARTS = "regexp_matches(lower({c}), '(^|[^a-z0-9]){w}')"
_EACH = " AND ".join("(" + " OR ".join(_STARTS.format(c=c, w=w) for c in op.SEARCHED) + ")" for w in ("bol", "stud"))
_SEARCH = Listing(search="Bol stud", english_only=False, classified_only=False)


@query("flt_12_prefix_search", sql(f"SELECT id FROM opportunities WHERE {ACTIVE} AND {_EACH}"))
def prefix_search(spark, d):
    """Looked up in the word index; the predicates look at what it finds alone."""
    return op.filtered(search_index.narrowed(opportunities(spark, d), index(spark, d), _SEARCH.search), _SEARCH, AS_OF).select("id")


@query("flt_13_search_fallback", sql("SELECT id FROM opportunities WHERE id % 4 = 0 AND contains(lower(title), 'ring')"))
def search_fallback(spark, d):
    """A quoted search is a plain substring: of titles that hold a quotation mark in front of the word, a quarter."""
    title = F.when(F.col("id") % 4 == 0, F.regexp_replace("title", "(?i)ring", '"ring')).otherwise(F.col("title"))
    return opportunities(spark, d).withColumn("title", title).where(op.search('"RING')).select("id")


_ids("flt_21_linkable_active", lambda: (F.col("opportunity_url") != "") & (F.col("status") == "Active") & (F.col("source_website") == "BUILDING"), "opportunity_url <> '' AND status = 'Active' AND source_website = 'BUILDING'")


@query("flt_22_domain_allow_list", "SELECT c_custkey, (c_custkey % 3 <> 2) AS allowed FROM customer")
def domain_allow_list(spark, d):
    mail = F.concat(F.lit("user@"), F.when(F.col("c_custkey") % 3 == 0, "example.org").when(F.col("c_custkey") % 3 == 1, "mail.example.org").otherwise("badexample.org"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", op.allowed_domain(mail, ["example.org"]).alias("allowed"))


@query("flt_23_option_filter", sql("SELECT DISTINCT country AS value FROM opportunities WHERE contains(lower(country), '_1') OR country IN ('NATION_2')"))
def option_filter(spark, d):
    return op.option_filter(opportunities(spark, d).select(F.col("country").alias("value")).distinct(), "_1", ["NATION_2"])


@query("flt_24_panel_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77')")
def panel_search(spark, d):
    return op.panel_search(spark.read.parquet(f"{d}/customer.parquet"), "77", ["c_name", "c_mktsegment"]).select("c_custkey")


@query("prj_01_api_projection", sql(f"SELECT id, title, country, category, deadline, opportunity_url FROM opportunities WHERE {SHOWN}"))
def api_projection(spark, d):
    return op.filtered(opportunities(spark, d), Listing(), AS_OF).select("id", "title", "country", "category", "deadline", "opportunity_url")


EXPORT = ["title", "organization", "country", "region", "funding_type", "vertical", "verticals", "work_type", "study_type", "category", "deadline", "website", "opportunity_url", "summary", "location", "eligibility", "funding_amount", "status", "source_website", "date_scraped"]


@query("prj_02_export_projection", sql(f"SELECT {', '.join(EXPORT)} FROM opportunities WHERE {ACTIVE}"))
def export_projection(spark, d):
    return op.filtered(opportunities(spark, d), EVERYTHING, AS_OF).select(*EXPORT)


@query("prj_03_distinct_columns", sql("SELECT DISTINCT country, region FROM opportunities"))
def distinct_columns(spark, d):
    return opportunities(spark, d).select("country", "region").distinct()


def _sorted(name: str, q: Listing, order: str, limit: int, where: str = ACTIVE):
    columns = ", ".join(BRIEF)
    query(name, sql(f"SELECT {columns} FROM opportunities WHERE {where} ORDER BY {order} LIMIT {limit}"))(lambda spark, d: op.filtered(opportunities(spark, d), q, AS_OF).orderBy(*op.ordering(q)).limit(limit).select(*BRIEF))


_sorted("srt_01_sort_nulls_last", Listing(sort_by="deadline", sort_dir="desc", english_only=False, classified_only=False), "deadline DESC NULLS LAST, id", 500)
_sorted("srt_01_sort_unknown_column", Listing(sort_by="nonsense", english_only=False, classified_only=False), "deadline ASC NULLS LAST, id", 500)
_sorted("srt_03_export_order", Listing(archived=True, english_only=False, classified_only=False), "deadline ASC NULLS LAST, id", 1000, "status = 'Expired'")


@query("srt_02_page", sql(f"SELECT id, title, (SELECT count(*) FROM opportunities WHERE {SHOWN}) AS total, CAST((SELECT ceil(count(*) / 40.0) FROM opportunities WHERE {SHOWN}) AS BIGINT) AS pages FROM opportunities WHERE {SHOWN} ORDER BY title ASC NULLS LAST, id LIMIT 40 OFFSET 80"))
def page(spark, d):
    return op.page(opportunities(spark, d), Listing(sort_by="title", page=3, page_size=40), AS_OF).select("id", "title", "total", "pages")


@query("srt_07_hash_sample", sql("SELECT id, opportunity_url FROM opportunities ORDER BY sha256(concat('7:', id)), id LIMIT 200"))
def hash_sample(spark, d):
    """A sample of 200 that its seed settles, whatever the engine."""
    return opportunities(spark, d).select("id", "opportunity_url").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("id").cast("string")), 256), "id").limit(200)


@query("srt_08_vocabulary", "SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT lower(p_type) AS term FROM part")
def vocabulary(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(F.col("p_name").alias("term")).union(part.select(F.lower("p_type"))).distinct().orderBy(F.lower("term"))


@query("srt_09_name_listing", "SELECT s_name FROM supplier ORDER BY s_name")
def name_listing(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_name").orderBy("s_name")


@query("srt_10_page_range", sql(f"SELECT concat('26–50 of ', CAST(count(*) AS VARCHAR)) AS label FROM opportunities WHERE {ACTIVE}"))
def page_range(spark, d):
    total = op.filtered(opportunities(spark, d), EVERYTHING, AS_OF).agg(F.count(F.lit(1)).alias("n"))
    return total.select(F.concat(F.lit(25 + 1), F.lit("–"), F.least(F.lit(50), F.col("n")), F.lit(" of "), F.col("n")).alias("label"))


@query("set_01_union_with_selection", sql("SELECT DISTINCT country AS value FROM opportunities UNION SELECT 'Atlantis'"))
def union_with_selection(spark, d):
    values = opportunities(spark, d).agg(F.collect_set("country").alias("v"))
    return values.select(F.explode(F.array_sort(F.array_union("v", F.array(F.lit("Atlantis"))))).alias("value"))


@query("set_02_difference", "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150")
def difference(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    seen = events.where("event_type = 'purchase' AND value > 150").select("user_id")
    return events.where("event_type = 'click'").select("user_id").distinct().join(seen, "user_id", "left_anti")


@query("set_03_intersection", sql("SELECT id, (CASE WHEN contains(verticals, 'Education') THEN 1 ELSE 0 END + CASE WHEN contains(verticals, 'Gender') THEN 1 ELSE 0 END) AS shared FROM opportunities"))
def intersection(spark, d):
    return opportunities(spark, d).select("id", F.size(F.array_intersect(op.labels(), F.array(F.lit("Education"), F.lit("Gender")))).alias("shared"))


@query("set_04_unknown_names", "SELECT DISTINCT lower(p_brand) AS name FROM part WHERE lower(p_brand) NOT IN (SELECT concat('brand#', s_nationkey) FROM supplier)")
def unknown_names(spark, d):
    """Requested names that are not registered: brands that no supplier's number stands for."""
    requested = spark.read.parquet(f"{d}/part.parquet").select(F.lower("p_brand").alias("name"))
    known = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("brand#"), F.col("s_nationkey").cast("string")).alias("name"))
    return planning.unknown(requested, known)


@query("set_06_disjoint_pages", "SELECT CAST(count(DISTINCT user_id) = count(*) AS BOOLEAN) AS disjoint FROM events WHERE event_type = 'click'")
def disjoint_pages(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where("event_type = 'click'").agg((F.countDistinct("user_id") == F.count(F.lit(1))).alias("disjoint"))
