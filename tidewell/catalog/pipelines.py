"""Composite queries: listing, statistics, ingest, maintenance, digests and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF, VERTICALS
from ..fixtures import MEMBERS_SQL, OPP, SENT_SQL, members, opportunities, sent_log, sql
from ..functions import links, text
from ..operators import filters as flt
from ..operators import routing
from ..operators import summaries
from ..operators.filters import Listing
from ..plans import ingest, maintenance
from ..registry import query
from .filters import SHOWN
from ..functions.lexicons import IMPLEMENTATION_PATTERNS, RESEARCH_PATTERNS, VERTICAL_PATTERNS
from .functions import _labels_sql, _places, _points
from .joins import _MATCHES

_PAGE = f"{SHOWN} AND region IN ('ASIA', 'EUROPE')"


@query("pip_02_listing_query", sql(f"SELECT id, title, country, region, category, deadline, (SELECT count(*) FROM opportunities WHERE {_PAGE}) AS total FROM opportunities WHERE {_PAGE} ORDER BY deadline ASC NULLS LAST, id LIMIT 25"))
def listing_query(spark, d):
    return flt.page(opportunities(spark, d), Listing(region=["ASIA", "EUROPE"]), AS_OF).select("id", "title", "country", "region", "category", "deadline", "total")


@query("pip_03_stats_bundle", sql(f"SELECT 'category' AS kind, category AS value, count(*) AS count FROM opportunities WHERE {SHOWN} AND category <> 'Other' GROUP BY category UNION ALL SELECT 'region', region, count(*) FROM opportunities WHERE {SHOWN} GROUP BY region UNION ALL SELECT 'total', 'all', count(*) FROM opportunities WHERE {SHOWN}"))
def stats_bundle(spark, d):
    rows = flt.filtered(opportunities(spark, d), Listing(), AS_OF)
    pairs = F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")), F.struct(F.lit("region").alias("kind"), F.col("region").alias("value")), F.struct(F.lit("total").alias("kind"), F.lit("all").alias("value")))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("count")).where("NOT (kind = 'category' AND value = 'Other')")


def _facet(column: str, *, without: str, fallback: bool = False, chosen: str = "", cap: int = 0) -> str:
    """A facet's values in SQL: under every predicate but its own."""
    narrowed = {"category": "category = 'Grant'", "region": "region = 'ASIA'"}
    where = " AND ".join([SHOWN, *(test for name, test in narrowed.items() if name != without)])
    own = f"SELECT DISTINCT {column} AS v FROM opportunities WHERE {where} AND trim({column}) <> ''" + (f" UNION SELECT '{chosen}'" if chosen else "")
    own = f"SELECT v FROM ({own}) AS u ORDER BY v" + (f" LIMIT {cap}" if cap else "")
    return f"SELECT '{column}' AS facet, (SELECT coalesce(list(v ORDER BY v), []) FROM ({own}) AS l) AS values"


_FACETS_SQL = " UNION ALL ".join([_facet("country", without=""), _facet("region", without="region", chosen="ASIA"), _facet("source_website", without=""), _facet("organization", without="", cap=500), "SELECT 'category', (SELECT list(v ORDER BY n) FROM (VALUES ('Grant', 1), ('RFP', 2), ('Tender', 3), ('Proposal', 4)) AS c(v, n) WHERE v = 'Grant' OR v IN (SELECT category FROM opportunities WHERE " + SHOWN + " AND region = 'ASIA'))", _facet("funding_type", without=""), f"SELECT 'verticals', {VERTICALS!r}"])


@query("pip_04_facets_bundle", sql(_FACETS_SQL))
def facets_bundle(spark, d):
    return summaries.facets(opportunities(spark, d), Listing(category=["Grant"], region=["ASIA"]), AS_OF)


@query("pip_05_member_digest", sql("SELECT member_id, id, region, place FROM (SELECT m.member_id, o.id, o.region, row_number() OVER (PARTITION BY m.member_id, o.region ORDER BY o.deadline ASC NULLS LAST, o.id) AS place FROM matches m JOIN opportunities o ON o.id = m.id JOIN members p ON p.member_id = m.member_id WHERE p.active AND p.auto_send AND NOT EXISTS (SELECT 1 FROM sent_log s WHERE s.member_id = m.member_id AND s.opportunity_id = m.id)) AS x WHERE place <= 6", OPP, MEMBERS_SQL, SENT_SQL, _MATCHES))
def member_digest(spark, d):
    people = members(spark).where("active AND auto_send")
    new = routing.unsent(routing.matches(opportunities(spark, d), people, AS_OF).select("member_id", "id", "region", "deadline"), sent_log(spark, d))
    return routing.digest(new, ["member_id", "region"], 6).select("member_id", "id", "region", "place")


query("pip_06_hand_picked", sql("SELECT v.id, v.pos, o.title FROM (VALUES (CAST(3 AS BIGINT), 0), (CAST(1 AS BIGINT), 1)) AS v(id, pos) LEFT JOIN opportunities o ON o.id = v.id"))(lambda spark, d: routing.pick_in_order(opportunities(spark, d), [3, 1]).select("id", "pos", "title"))


@query("pip_07_reminders", sql("SELECT s.member_id, count(*) AS n FROM sent_log s JOIN opportunities o ON o.id = s.opportunity_id JOIN members m ON m.member_id = s.member_id WHERE o.status = 'Active' AND m.active AND o.deadline IN (DATE '1998-08-12', DATE '1998-08-09', DATE '1998-08-04') GROUP BY s.member_id", OPP, MEMBERS_SQL, SENT_SQL))
def reminders(spark, d):
    return routing.due_reminders(opportunities(spark, d), members(spark), sent_log(spark, d), AS_OF, [10, 7, 2]).groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))


def _raw(spark, d):
    rows = opportunities(spark, d)
    return rows.select("id", "title", "organization", "country", "region", "funding_type", "vertical", F.col("category").alias("category_hint"), F.when(F.col("deadline").isNull(), "Rolling basis").otherwise(F.date_format("deadline", "d MMMM yyyy")).alias("deadline_raw"), "website", "opportunity_url", "summary", "location", "eligibility", "funding_amount", "source_website", F.lit(True).alias("dayfirst"), F.lit(False).alias("assume_active"))


@query("pip_01_ingest", sql("SELECT id, deadline, status FROM (SELECT id, title, organization, opportunity_url, CASE WHEN deadline > DATE '2001-08-01' THEN NULL ELSE deadline END AS deadline, 'Active' AS status, deadline AS d FROM opportunities) AS x WHERE d IS NULL OR (d >= DATE '1998-08-02' AND d <= DATE '2001-08-01')"))
def ingest_rows(spark, d):
    rules = ingest.Rules(AS_OF, places=_places(spark, d))
    return ingest.accepted(ingest.judged(_raw(spark, d), rules), rules).select("id", "deadline", "status")


@query("pip_01_ingest_insert", sql("SELECT min(id) AS id, title FROM (SELECT *, CASE WHEN deadline > DATE '2001-08-01' THEN NULL ELSE deadline END AS d FROM opportunities) AS x WHERE (deadline IS NULL OR (deadline >= DATE '1998-08-02' AND deadline <= DATE '2001-08-01')) AND NOT EXISTS (SELECT 1 FROM opportunities t WHERE t.category = 'Tender' AND t.title = x.title AND t.organization = x.organization AND t.deadline IS NOT DISTINCT FROM x.d AND t.opportunity_url = x.opportunity_url) GROUP BY title, organization, d, opportunity_url"))
def ingest_insert(spark, d):
    """From raw listings, all of them twice, to the rows that are inserted: each once, and none that the table has."""
    raw, rules = _raw(spark, d), ingest.Rules(AS_OF, places=_places(spark, d))
    table = opportunities(spark, d).where("category = 'Tender'").select(text.unique_id(F.col("title"), F.col("organization"), F.col("deadline"), F.col("opportunity_url")).alias("unique_id"))
    return ingest.ingested(raw.union(raw.withColumn("id", F.col("id") + 10_000_000_000)), table, rules, ["id"]).select("id", "title")


@query("pip_01_ingest_counters", sql("SELECT source_website, count(*) AS found, count(*) FILTER (WHERE deadline < DATE '1998-08-02' OR deadline > DATE '2001-08-01') AS is_expired FROM opportunities GROUP BY source_website"))
def ingest_counters(spark, d):
    rules = ingest.Rules(AS_OF, places=_places(spark, d))
    return ingest.counters(ingest.judged(_raw(spark, d), rules)).select("source_website", "found", "is_expired")


def _job(name: str, new, oracle: str | None = None):
    @query(name, sql(oracle) if oracle else None)
    def run(spark, d):
        return maintenance.changed(opportunities(spark, d), new(spark, d))


_BODY = "concat_ws(' ', nullif(summary, ''), nullif(vertical, ''), nullif(eligibility, ''))"
_job("mnt_01_verticals_backfill", lambda s, d: maintenance.verticals(), f"SELECT * FROM (SELECT id, verticals AS old_verticals, {_labels_sql(VERTICAL_PATTERNS, _BODY)} AS new_verticals FROM opportunities) AS x WHERE old_verticals <> new_verticals")
@query("mnt_02_geography_backfill", sql("SELECT id, old_country, 'NOWHERE' AS old_region, country AS new_country, region AS new_region FROM (SELECT *, CASE id % 3 WHEN 0 THEN concat('Lot 4 and ', country) WHEN 1 THEN '' ELSE country END AS old_country FROM opportunities) AS x"))
def geography_backfill(spark, d):
    """Rows whose country a source wrote badly or not at all, and whose region is wrong: the location tells both."""
    bad = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Lot 4 and "), "country")).when(F.col("id") % 3 == 1, "").otherwise(F.col("country"))
    rows = opportunities(spark, d).withColumn("country", bad).withColumn("region", F.lit("NOWHERE"))
    return maintenance.changed(rows, maintenance.geography(_places(spark, d)))


@query("mnt_03_organization_backfill", sql("SELECT id, CASE WHEN id % 2 = 0 THEN '118,391 7' ELSE '' END AS old_organization, CASE WHEN id % 2 = 0 THEN '' ELSE 'Green Trust' END AS new_organization FROM opportunities WHERE id % 5 < 3"))
def organization_backfill(spark, d):
    """Names that are numbers are cleared, blanks are read from the summary, the rest stays."""
    name = F.when(F.col("id") % 5 >= 3, F.col("organization")).when(F.col("id") % 2 == 0, "118,391 7").otherwise("")
    rows = opportunities(spark, d).withColumn("organization", name).withColumn("summary", F.concat(F.lit("The Green Trust is inviting applications. "), "summary"))
    return maintenance.changed(rows, maintenance.organization())


_job("mnt_04_amount_backfill", lambda s, d: maintenance.amount(), "SELECT id, funding_amount AS old_funding_amount, concat('up to ', regexp_extract(summary, 'USD [0-9]+')) AS new_funding_amount FROM opportunities WHERE funding_amount = ''")
_WORK_BODY = "concat_ws(' ', nullif(summary, ''), nullif(eligibility, ''), nullif(vertical, ''))"
_job("mnt_05_work_type_backfill", lambda s, d: maintenance.work_type(), f"SELECT id, old_work_type, new_work_type FROM (SELECT id, work_type AS old_work_type, CASE WHEN greatest(r, i) < 3 OR abs(r - i) < 2 THEN '' WHEN r > i THEN 'Research' ELSE 'Implementation' END AS new_work_type FROM (SELECT id, work_type, {_points(RESEARCH_PATTERNS, body=_WORK_BODY)} AS r, {_points(IMPLEMENTATION_PATTERNS, body=_WORK_BODY)} AS i FROM opportunities) AS s) AS x WHERE old_work_type <> new_work_type")
_job("mnt_06_study_type_backfill", lambda s, d: maintenance.study_type(), "SELECT id, study_type AS old_study_type, 'Data Collection' AS new_study_type FROM opportunities WHERE study_type = ''")
_job("mnt_07_link_repair", lambda s, d: maintenance.link(), "SELECT id, opportunity_url AS old_opportunity_url, '' AS new_opportunity_url FROM opportunities WHERE opportunity_url LIKE '%/view/12,13'")


@query("mnt_08_deadline_audit", sql("SELECT count(*) FILTER (WHERE deadline > DATE '2001-08-01') AS sentinels_cleared, count(*) FILTER (WHERE deadline <= DATE '2001-08-01' AND deadline < DATE '1998-08-02' AND status = 'Active') AS expired, count(*) FILTER (WHERE deadline <= DATE '2001-08-01' AND deadline >= DATE '1998-08-02' AND status = 'Expired') AS reactivated FROM opportunities"))
def deadline_audit(spark, d):
    return maintenance.deadline(opportunities(spark, d), AS_OF)


@query("agg_16_change_counters", sql("SELECT count(*) AS changed FROM opportunities WHERE opportunity_url LIKE '%/view/12,13'"))
def change_counters(spark, d):
    return maintenance.changed(opportunities(spark, d), maintenance.link()).agg(F.count(F.lit(1)).alias("changed"))


@query("mnt_09_spam_purge", sql("SELECT id FROM opportunities WHERE id % 6 <> 1"))
def spam_purge(spark, d):
    rows = opportunities(spark, d).withColumn("title", F.when(F.col("id") % 6 == 1, F.concat("title", F.lit(" call +971 50 123 4567"))).otherwise(F.col("title")))
    return maintenance.purged(rows, text.spam(F.col("title"), F.col("summary"))).select("id")


@query("mnt_10_non_english_purge", sql("SELECT id FROM opportunities WHERE id % 5 <> 2 AND id % 5 <> 4"))
def non_english_purge(spark, d):
    """Titles in another script go: of eight scripts two are tried here."""
    title = F.when(F.col("id") % 5 == 2, F.concat(F.lit("Конкурс "), "title")).when(F.col("id") % 5 == 4, F.concat(F.lit("公告 "), "title")).otherwise(F.col("title"))
    return maintenance.purged(opportunities(spark, d).withColumn("title", title), ~flt.english()).select("id")


@query("mnt_11_source_dedupe", sql("SELECT source_website, count(*) AS n FROM (SELECT CASE source_website WHEN 'BUILDING' THEN 'MACHINERY' ELSE source_website END AS source_website FROM opportunities) AS x GROUP BY source_website"))
def source_dedupe(spark, d):
    return maintenance.renamed_sources(opportunities(spark, d), {"BUILDING": "MACHINERY"}).groupBy("source_website").agg(F.count(F.lit(1)).alias("n"))


@query("mnt_12_link_check", sql("SELECT source_website, count(*) FILTER (WHERE opportunity_url = '') AS missing, count(*) AS n FROM opportunities GROUP BY source_website"))
def link_check(spark, d):
    rows = opportunities(spark, d).withColumn("kind", links.kind(F.col("opportunity_url")))
    return summaries.verdicts(rows).select("source_website", F.col("none").alias("missing"), "n")


@query("mnt_13_schema_migration", sql("SELECT id, source_website AS source, 'none' AS note FROM opportunities"))
def schema_migration(spark, d):
    rows = opportunities(spark, d).select("id", "source_website")
    return maintenance.migrated(rows, {"note": F.lit("none"), "id": F.lit(0)}, {"source_website": "source"})
