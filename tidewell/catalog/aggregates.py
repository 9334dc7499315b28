"""Aggregations, facets and per-group ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF, ENABLED_CATEGORIES, VERTICALS
from ..fixtures import CRAWL_SQL, MEMBERS_SQL, OPP, SENT_SQL, crawl, members, opportunities, sent_log, sql
from ..functions import links
from ..operators import filters as flt
from ..operators import search_index, sketches
from ..operators import summaries as op
from ..operators.filters import Listing
from ..operators.routing import digest, fitting_cap, region_rank, stale_cut
from ..registry import query
from ..shared import scratch
from .filters import ACTIVE, EVERYTHING, SHOWN


def _shown(spark, d):
    return flt.filtered(opportunities(spark, d), Listing(), AS_OF)


@query("agg_01_total", sql(f"SELECT count(*) AS total FROM opportunities WHERE {SHOWN}"))
def total(spark, d):
    return _shown(spark, d).agg(F.count(F.lit(1)).alias("total"))


@query("agg_02_group_counts", sql(f"SELECT country AS value, count(*) AS count FROM opportunities WHERE {SHOWN} GROUP BY country ORDER BY count(*) DESC, country LIMIT 12"))
def group_counts(spark, d):
    return op.group_counts(_shown(spark, d), "country")


_CASES = " UNION ALL ".join(f"SELECT '{v}' AS value, {i + 1} AS place, count(*) AS count FROM opportunities WHERE {ACTIVE} AND contains(verticals, '{v}')" for i, v in enumerate(VERTICALS))


@query("agg_03_label_counts", sql(f"SELECT * FROM ({_CASES}) AS c WHERE count > 0"))
def label_counts(spark, d):
    return op.label_counts(flt.filtered(opportunities(spark, d), EVERYTHING, AS_OF))


@query("agg_04_new_today", sql(f"SELECT count(*) AS total, count(*) FILTER (WHERE CAST(date_scraped AS DATE) = DATE '1998-08-02') AS new_today FROM opportunities WHERE {SHOWN}"))
def new_today(spark, d):
    return op.headline(_shown(spark, d), AS_OF)


@query("agg_05_last_run", "SELECT max(ts) AS last_run FROM events")
def last_run(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").agg(F.max("ts").alias("last_run"))


@query("agg_06_enabled_counts", sql("SELECT category AS value, count(*) AS count FROM opportunities WHERE category IN ('Grant', 'RFP', 'Tender', 'Proposal') GROUP BY category"))
def enabled_counts(spark, d):
    return op.group_counts(opportunities(spark, d), "category").where(F.col("value").isin(ENABLED_CATEGORIES))


@query("agg_07_distinct_values", sql("SELECT DISTINCT funding_type AS value FROM opportunities WHERE trim(funding_type) <> ''"))
def distinct_values(spark, d):
    return opportunities(spark, d).where(op.present("funding_type")).select(F.col("funding_type").alias("value")).distinct().orderBy("value")


@query("agg_08_cross_source_duplicates", sql("SELECT title, deadline, count(*) AS n, count(DISTINCT source_website) AS sources FROM opportunities GROUP BY title, deadline HAVING count(*) > 1 AND count(DISTINCT source_website) > 1 ORDER BY n DESC, title, deadline ASC NULLS FIRST LIMIT 200"))
def cross_source_duplicates(spark, d):
    return op.cross_source_duplicates(opportunities(spark, d))


@query("agg_09_rows_per_source", sql("SELECT source_website, count(*) AS n FROM opportunities GROUP BY source_website"))
def rows_per_source(spark, d):
    return opportunities(spark, d).groupBy("source_website").agg(F.count(F.lit(1)).alias("n"))


_KIND = "CASE WHEN opportunity_url = '' THEN '' WHEN opportunity_url LIKE '%/grants/' THEN 'listing' ELSE 'deep' END"


@query("agg_10_link_verdicts", sql(f"SELECT source_website, count(*) AS n, count(*) FILTER (WHERE k = 'deep') AS deep, count(*) FILTER (WHERE k = 'listing') AS listing, count(*) FILTER (WHERE k = '') AS none, round(100.0 * count(*) FILTER (WHERE k = 'deep') / count(*), 1) AS deep_pct FROM (SELECT source_website, {_KIND} AS k FROM opportunities) AS x GROUP BY source_website"))
def link_verdicts(spark, d):
    return op.verdicts(opportunities(spark, d).withColumn("kind", links.kind(F.col("opportunity_url"))))


@query("agg_11_worst_sources", sql(f"SELECT country, count(*) AS bad FROM (SELECT country, {_KIND} AS k FROM opportunities) AS x WHERE k <> 'deep' GROUP BY country ORDER BY bad DESC, country LIMIT 12"))
def worst_sources(spark, d):
    rows = opportunities(spark, d).where(links.kind(F.col("opportunity_url")) != "deep")
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("bad")).orderBy(F.desc("bad"), "country").limit(12)


@query("agg_12_non_english_per_source", sql("SELECT source_website, count(*) AS n FROM opportunities WHERE id % 9 < 8 GROUP BY source_website"))
def non_english_per_source(spark, d):
    """Titles that hold a letter of one of eight scripts, which eight of nine have here."""
    letters = F.array(*map(F.lit, "שلЖकก新の한"))
    title = F.concat(F.coalesce(F.get(letters, (F.col("id") % 9).cast("int")), F.lit("Ö")), F.lit(" "), "title")
    return opportunities(spark, d).withColumn("title", title).where(~flt.english()).groupBy("source_website").agg(F.count(F.lit(1)).alias("n"))


@query("agg_13_run_counters", f"WITH {CRAWL_SQL} SELECT source, count(DISTINCT page) AS pages, count(*) AS found, count(DISTINCT item) AS fresh, round(100 * (1 - count(DISTINCT item) / CAST(count(*) AS DOUBLE)), 2) AS repeat_pct FROM crawl GROUP BY source")
def run_counters(spark, d):
    return op.run_counters(crawl(spark, d))


@query("agg_13_repeats_by_sketch", f"WITH {CRAWL_SQL} SELECT source, count(DISTINCT page) AS pages, count(*) AS found, count(DISTINCT item) AS exact, true AS close FROM crawl GROUP BY source")
def repeats_by_sketch(spark, d):
    """Repeats of each source from sketches that were stored page by page, beside the exact count: within five standard errors."""
    at, items = scratch(spark, "sketches"), crawl(spark, d)
    sketches.page_sketches(items).write.parquet(at)
    exact = items.groupBy("source").agg(F.countDistinct("item").alias("exact"))
    about = sketches.repeats(spark.read.parquet(at)).join(exact, "source")
    close = F.abs(F.col("fresh") - F.col("exact")) <= 1 + 5 * F.col("exact") * 1.04 / 2 ** (sketches.BITS / 2)
    return about.select("source", "pages", "found", "exact", close.alias("close"))


@query("agg_15_dispatch_totals", f"WITH {SENT_SQL} SELECT count(DISTINCT member_id) AS members, count(*) AS items FROM sent_log")
def dispatch_totals(spark, d):
    return sent_log(spark, d).agg(F.countDistinct("member_id").alias("members"), F.count(F.lit(1)).alias("items"))


@query("agg_17_lists_by_region", sql(f"SELECT region, string_agg(CAST(id AS VARCHAR), ',' ORDER BY deadline ASC NULLS LAST, id) AS ids FROM opportunities WHERE {ACTIVE} AND category = 'Grant' GROUP BY region"))
def lists_by_region(spark, d):
    rows = opportunities(spark, d).where(flt.active(AS_OF) & (F.col("category") == "Grant"))
    struct = F.struct(F.col("deadline").isNull().alias("o"), F.coalesce("deadline", F.lit(AS_OF)).alias("d"), "id")
    return rows.groupBy("region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(struct)), lambda x: x["id"].cast("string")), ",").alias("ids"))


def _audit(name: str, body: str):
    text = sql(body)

    @query(name, text)
    def run(spark, d):
        return spark.sql(body.replace("opportunities", "{opps}"), opps=opportunities(spark, d))


_audit("agg_18a_status_counts", "SELECT status, count(*) AS n FROM opportunities GROUP BY status")
_audit("agg_18b_top_sources", "SELECT source_website, count(*) AS n FROM opportunities WHERE status = 'Active' GROUP BY source_website ORDER BY n DESC, source_website LIMIT 15")
_audit("agg_18c_classified_split", "SELECT SUM(CASE WHEN verticals <> '' THEN 1 ELSE 0 END) AS classified, SUM(CASE WHEN verticals = '' THEN 1 ELSE 0 END) AS unclassified FROM opportunities WHERE status = 'Active'")
_audit("agg_18d_label_histogram", "SELECT length(verticals) - length(replace(verticals, ',', '')) + 1 AS labels, count(*) AS n FROM opportunities WHERE verticals <> '' GROUP BY 1")
_audit("agg_18e_week_ahead", "SELECT id, deadline FROM opportunities WHERE deadline BETWEEN DATE '1998-08-02' AND DATE '1998-08-09'")
_audit("agg_18f_having_duplicates", "SELECT title, organization, count(*) AS n FROM opportunities GROUP BY title, organization HAVING count(*) > 1")
query("agg_18h_run_history", "SELECT event_type AS source, count(DISTINCT date_trunc('hour', ts)) AS pages, count(*) AS found, count(DISTINCT user_id) AS saved, count(*) FILTER (WHERE value < 1) AS errors, max(ts) AS finished_at FROM events GROUP BY event_type")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("source")).agg(F.countDistinct(F.date_trunc("hour", "ts")).alias("pages"), F.count(F.lit(1)).alias("found"), F.countDistinct("user_id").alias("saved"), F.count_if(F.col("value") < 1).alias("errors"), F.max("ts").alias("finished_at"))
)
query("agg_18i_mails_per_member", sql("SELECT m.name, count(s.opportunity_id) AS received FROM members m LEFT JOIN sent_log s ON s.member_id = m.member_id GROUP BY m.name", OPP, MEMBERS_SQL, SENT_SQL))(
    lambda spark, d: members(spark).select("member_id", "name").join(sent_log(spark, d), "member_id", "left").groupBy("name").agg(F.count("opportunity_id").alias("received"))
)


@query("agg_18j_titles_by_word", sql("SELECT id, title FROM opportunities WHERE regexp_matches(lower(concat_ws(' | ', title, organization, summary, vertical, country, eligibility)), '(^|[^a-z0-9])stu')"))
def titles_by_word(spark, d):
    """Titles of the listings that hold a word with a certain beginning, looked up in the word index."""
    at, rows = scratch(spark, "index"), opportunities(spark, d)
    search_index.add_batch(at, 1, rows)
    return search_index.searched(rows, at, "stu").select("id", "title")


_audit("agg_18g_work_type_by_category", "SELECT category, work_type, count(*) AS n FROM opportunities GROUP BY category, work_type")


@query("agg_19_repeat_share", f"WITH {CRAWL_SQL} SELECT round(1 - count(DISTINCT item) / CAST(count(*) AS DOUBLE), 6) AS repeats FROM crawl")
def repeat_share(spark, d):
    return crawl(spark, d).agg(F.round(1 - F.countDistinct("item") / F.count(F.lit(1)), 6).alias("repeats"))


@query("agg_20_coverage", f"WITH {CRAWL_SQL} SELECT count(DISTINCT item) AS \"distinct\", round(100 * count(DISTINCT item) / CAST(5000 AS DOUBLE), 2) AS coverage_pct FROM crawl")
def coverage(spark, d):
    return op.coverage(crawl(spark, d), "item", 5000)


_Q = Listing(country=["NATION_3", "NATION_4"], category=["Grant"], region=["ASIA"])
_OWN = {"country": "country IN ('NATION_3', 'NATION_4')", "category": "category IN ('Grant')", "region": "region IN ('ASIA')"}


def _facet_sql(facet: str) -> str:
    where = " AND ".join([SHOWN, *(test for own, test in _OWN.items() if own != facet)])
    return f"SELECT '{facet}' AS facet, string_agg(v, '|' ORDER BY v) AS vals FROM (SELECT DISTINCT {facet} AS v FROM opportunities WHERE {where} AND trim({facet}) <> '') AS x"


def _facet_query(spark, d, names, q=_Q):
    rows = op.facets(opportunities(spark, d), q, AS_OF).where(F.col("facet").isin(names))
    return rows.select("facet", F.nullif(F.array_join("values", "|"), F.lit("")).alias("vals"))


@query("fac_01_facets_without_own_filter", sql(" UNION ALL ".join(map(_facet_sql, ("funding_type", "organization")))))
def facets_without_own(spark, d):
    return _facet_query(spark, d, ["funding_type", "organization"])


@query("fac_02_one_scan_facets", sql(_facet_sql("source_website")))
def one_scan(spark, d):
    return _facet_query(spark, d, ["source_website"])


@query("fac_03_fallback_to_all", sql("SELECT 'region' AS facet, string_agg(v, '|' ORDER BY v) AS vals FROM (SELECT DISTINCT region AS v FROM opportunities) AS x"))
def fallback(spark, d):
    return _facet_query(spark, d, ["region"], Listing(country=["Atlantis"]))


@query("fac_04_selected_stay", sql("SELECT 'country' AS facet, string_agg(v, '|' ORDER BY v) AS vals FROM (SELECT DISTINCT country AS v FROM opportunities WHERE " + SHOWN + " AND region = 'ASIA' UNION SELECT 'Atlantis') AS x"))
def selected_stay(spark, d):
    return _facet_query(spark, d, ["country"], Listing(country=["Atlantis"], region=["ASIA"]))


_PLACE = "CASE v WHEN 'Grant' THEN 1 WHEN 'RFP' THEN 2 WHEN 'Tender' THEN 3 ELSE 4 END"


@query("fac_05_category_facet", sql(f"SELECT 'category' AS facet, string_agg(v, '|' ORDER BY {_PLACE}) AS vals FROM (SELECT DISTINCT category AS v FROM opportunities WHERE {SHOWN} AND country IN ('NATION_3', 'NATION_4') AND category <> 'Other' UNION SELECT 'Grant') AS x"))
def category_facet(spark, d):
    return _facet_query(spark, d, ["category"], Listing(country=["NATION_3", "NATION_4"], category=["Grant"]))


@query("fac_06_verticals_facet", f"SELECT 'verticals' AS facet, '{'|'.join(VERTICALS)}' AS vals")
def verticals_facet(spark, d):
    return _facet_query(spark, d, ["verticals"])


_RANKED = f"SELECT id, region, row_number() OVER (PARTITION BY region ORDER BY deadline ASC NULLS LAST, id) AS place, greatest(count(*) OVER (PARTITION BY region) - 10, 0) AS hidden FROM opportunities WHERE {ACTIVE}"


@query("win_01_order_in_region", sql(f"SELECT id, region, place FROM ({_RANKED}) AS x WHERE place <= 50"))
def order_in_region(spark, d):
    return digest(opportunities(spark, d).where(flt.active(AS_OF)), ["region"], 50).select("id", "region", "place")


@query("win_02_top_n_per_region", sql(f"SELECT id, region, place, hidden FROM ({_RANKED}) AS x WHERE place <= 10"))
def top_n(spark, d):
    return digest(opportunities(spark, d).where(flt.active(AS_OF)), ["region"], 10).select("id", "region", "place", "hidden")


@query("win_03_region_order", sql("SELECT DISTINCT region, CASE region WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 10000 END AS at FROM opportunities"))
def region_order(spark, d):
    return opportunities(spark, d).select("region", region_rank("region", ["EUROPE", "ASIA"]).cast("int").alias("at")).distinct()


_SUMS = ", ".join(f"sum(CASE WHEN p <= {c} THEN s ELSE 0 END) AS s{c}" for c in (25, 15, 10, 6, 4, 2))


@query("win_04_cap_ladder", sql(f"SELECT member_id, CASE WHEN s25 <= 20000 THEN 25 WHEN s15 <= 20000 THEN 15 WHEN s10 <= 20000 THEN 10 WHEN s6 <= 20000 THEN 6 WHEN s4 <= 20000 THEN 4 ELSE 2 END AS cap FROM (SELECT member_id, {_SUMS} FROM (SELECT id % 7 AS member_id, length(title) + length(summary) + 100 AS s, row_number() OVER (PARTITION BY id % 7, region ORDER BY deadline ASC NULLS LAST, id) AS p FROM opportunities WHERE {ACTIVE}) AS x GROUP BY member_id) AS y"))
def cap_ladder(spark, d):
    rows = opportunities(spark, d).where(flt.active(AS_OF)).withColumn("member_id", F.col("id") % 7)
    return fitting_cap(rows, "region", F.length("title") + F.length("summary") + 100, budget=20_000)


_PAGES = "SELECT user_id AS source, CAST(event_id AS BIGINT) AS page, 1 + event_id % 3 AS found, CASE WHEN event_id % 5 < 3 THEN 0 ELSE 1 END AS saved FROM events"


@query(
    "win_05_stale_streak",
    f"WITH p AS ({_PAGES}), g AS (SELECT *, sum(CASE WHEN saved = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY page) AS grp FROM p), r AS (SELECT source, page, sum(CASE WHEN saved = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, grp ORDER BY page) AS streak FROM g), e AS (SELECT *, coalesce(max(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM r) SELECT source, page, CAST(streak AS BIGINT) AS streak FROM e WHERE over_ = 0",
)
def stale_streak(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    pages = events.select(F.col("user_id").alias("source"), F.col("event_id").cast("long").alias("page"), (1 + F.col("event_id") % 3).alias("found"), F.when(F.col("event_id") % 5 < 3, 0).otherwise(1).alias("saved"))
    return stale_cut(pages, 3).select("source", "page", F.col("streak").cast("long").alias("streak"))


@query("win_06_first_seen", sql("SELECT title, min(id) AS id FROM opportunities GROUP BY title"))
def first_seen(spark, d):
    return op.first_seen(opportunities(spark, d).select("title", "id"), "title", ["id"])


@query("win_09_last_entries", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def last_entries(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("srt_04_upcoming", sql(f"SELECT id, deadline FROM opportunities WHERE {SHOWN} AND deadline >= DATE '1998-08-02' ORDER BY deadline, id LIMIT 8"))
def upcoming(spark, d):
    return op.upcoming(_shown(spark, d), AS_OF).select("id", "deadline")


@query("srt_06_facet_caps", sql(f"SELECT v AS organization FROM (SELECT DISTINCT organization AS v FROM opportunities WHERE {SHOWN}) AS x ORDER BY v LIMIT 500"))
def facet_caps(spark, d):
    return op.facets(opportunities(spark, d), Listing(), AS_OF).where("facet = 'organization'").select(F.explode("values").alias("organization"))


