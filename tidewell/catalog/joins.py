"""Joins, ledgers and sinks."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..config import AS_OF, REMINDER_DAYS
from ..fixtures import MEMBERS_SQL, OPP, SENT_SQL, SUBSCRIBERS_SQL, members, opportunities, sent_log, sql, subscribers
from ..operators import routing as op
from ..operators.key_table import KeyTable
from ..operators.filters import labels
from ..operators.summaries import latest_by_key
from ..plans import ingest, maintenance
from ..operators import search_index
from ..registry import query
from ..shared import scratch
from .filters import ACTIVE

_ENDS = " OR ".join(f"deadline = DATE '{AS_OF + datetime.timedelta(days=n)}'" for n in REMINDER_DAYS)
_DUE = f"SELECT s.member_id, o.id, CAST(o.deadline - DATE '1998-08-02' AS INTEGER) AS days_before, o.deadline FROM sent_log s JOIN opportunities o ON s.opportunity_id = o.id JOIN members m ON m.member_id = s.member_id WHERE o.status = 'Active' AND m.active AND ({_ENDS})"
_KW = lambda words: " OR ".join(f"contains(lower({c}), '{w}')" for w in words for c in op.MATCHED)
_WANTS = [
    (1, _KW(["ring", "bolt"])),
    (2, "category IN ('Grant', 'RFP') AND (contains(lower(verticals), 'health') OR lower(vertical) = 'health')"),
    (3, f"({_KW(['widget'])}) AND category IN ('Tender')"),
    (4, "true"),
    (5, f"({_KW(['gear'])}) AND (contains(lower(verticals), 'education') OR contains(lower(verticals), 'climate') OR lower(vertical) IN ('education', 'climate'))"),
]
_MATCHES = "matches AS (" + " UNION ALL ".join(f"SELECT CAST({m} AS BIGINT) AS member_id, id FROM opportunities WHERE {ACTIVE} AND ({w})" for m, w in _WANTS) + ")"
_REMINDED = "reminder_log AS (SELECT CAST(l_suppkey % 5 + 1 AS BIGINT) AS member_id, l_orderkey AS opportunity_id, 7 AS days_before FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 2 = 0 GROUP BY 1, 2)"


def _reminded(spark, d):
    return sent_log(spark, d).where("opportunity_id % 2 = 0").select("member_id", "opportunity_id", F.lit(7).alias("days_before"))


@query("jon_01_reminder_join", sql(_DUE, OPP, MEMBERS_SQL, SENT_SQL))
def reminder_join(spark, d):
    return op.due_reminders(opportunities(spark, d), members(spark), sent_log(spark, d), AS_OF, list(REMINDER_DAYS))


@query("jon_02_not_yet_sent", sql("SELECT m.member_id, m.id FROM matches m WHERE NOT EXISTS (SELECT 1 FROM sent_log s WHERE s.member_id = m.member_id AND s.opportunity_id = m.id)", OPP, SENT_SQL, _MATCHES))
def not_yet_sent(spark, d):
    return op.unsent(op.matches(opportunities(spark, d), members(spark), AS_OF).select("member_id", "id"), sent_log(spark, d))


@query("jon_03_member_matches", sql("SELECT member_id, id FROM matches", OPP, _MATCHES))
def member_matches(spark, d):
    return op.matches(opportunities(spark, d), members(spark), AS_OF).select("member_id", "id")


_BOTH = "list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"


@query("jon_03_subscriber_matches", sql(f"SELECT s.member_id, o.id FROM (SELECT member_id, list_transform({_BOTH.format(c='keywords')}, lambda x: lower(x)) AS kw, list_filter({_BOTH.format(c='categories')}, lambda x: x IN ('Grant', 'RFP', 'Tender', 'Proposal', 'Fellowship', 'Award', 'Challenge', 'Other')) AS cats, list_transform({_BOTH.format(c='verticals')}, lambda x: lower(x)) AS verts FROM subscribers) AS s, (SELECT id, category, lower(verticals) AS labels, lower(vertical) AS label, lower(concat_ws(' | ', title, organization, summary, vertical)) AS low FROM opportunities WHERE {ACTIVE}) AS o WHERE (len(cats) = 0 OR list_contains(cats, o.category)) AND len(list_filter(kw, lambda k: contains(o.low, k))) > 0 AND (len(verts) = 0 OR list_contains(verts, o.label) OR len(list_filter(verts, lambda v: contains(o.labels, v))) > 0)", OPP, SUBSCRIBERS_SQL))
def subscriber_matches(spark, d):
    """Every customer as a member, however many there are: all their keywords in one pass over each listing."""
    return op.matches(opportunities(spark, d), subscribers(spark, d), AS_OF).select("member_id", "id")


query("flt_14_match_predicate", sql("SELECT id FROM matches WHERE member_id = 5", OPP, _MATCHES))(lambda spark, d: op.matches(opportunities(spark, d), members(spark).where("member_id = 5"), AS_OF).select("id"))


@query("jon_04_not_yet_reminded", sql(f"SELECT * FROM ({_DUE}) AS x WHERE NOT EXISTS (SELECT 1 FROM reminder_log r WHERE r.member_id = x.member_id AND r.opportunity_id = x.id AND r.days_before = x.days_before)", OPP, MEMBERS_SQL, SENT_SQL, _REMINDED))
def not_yet_reminded(spark, d):
    return op.due_reminders(opportunities(spark, d), members(spark), sent_log(spark, d), AS_OF, list(REMINDER_DAYS), _reminded(spark, d))


@query("jon_05_dedup_lookup", sql("SELECT count(*) AS n FROM (SELECT DISTINCT title FROM opportunities WHERE title NOT IN (SELECT title FROM opportunities WHERE id % 5 = 1)) AS x"))
def dedup_lookup(spark, d):
    rows = opportunities(spark, d).withColumn("unique_id", F.sha2("title", 256))
    return ingest.only_new(rows, rows.where("id % 5 = 1"), ["id"]).agg(F.count(F.lit(1)).alias("n"))


@query("jon_06_semi_by_ids", sql("SELECT id, title FROM opportunities WHERE id IN (SELECT opportunity_id FROM sent_log WHERE member_id = 1)", OPP, SENT_SQL))
def semi_by_ids(spark, d):
    return opportunities(spark, d).select("id", "title").join(sent_log(spark, d).where("member_id = 1").select(F.col("opportunity_id").alias("id")), "id", "left_semi")


@query("jon_08_selection_in_order", sql("SELECT v.id, v.pos, o.title FROM (VALUES (CAST(40 AS BIGINT), 0), (CAST(7 AS BIGINT), 1), (CAST(-5 AS BIGINT), 2), (CAST(12 AS BIGINT), 3)) AS v(id, pos) LEFT JOIN opportunities o ON o.id = v.id"))
def selection_in_order(spark, d):
    return op.pick_in_order(opportunities(spark, d), [40, 7, -5, 12]).select("id", "pos", "title")


@query("jon_09_members_without_rows", sql("SELECT m.member_id, coalesce(s.n, 0) AS n FROM members m LEFT JOIN (SELECT member_id, count(*) AS n FROM matches GROUP BY member_id) AS s ON s.member_id = m.member_id", OPP, MEMBERS_SQL, _MATCHES))
def members_without_rows(spark, d):
    n = op.matches(opportunities(spark, d), members(spark), AS_OF).groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
    return members(spark).select("member_id").join(n, "member_id", "left").select("member_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("jon_10_orphan_sources", sql("SELECT DISTINCT source_website FROM opportunities WHERE source_website NOT IN ('BUILDING', 'MACHINERY')"))
def orphan_sources(spark, d):
    known = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "source_website string")
    return opportunities(spark, d).select("source_website").distinct().join(known, "source_website", "left_anti")


@query("jon_11_source_rename", sql("SELECT id, CASE source_website WHEN 'BUILDING' THEN 'Construction' ELSE source_website END AS source_website FROM opportunities"))
def source_rename(spark, d):
    return maintenance.renamed_sources(opportunities(spark, d), {"BUILDING": "Construction"}).select("id", "source_website")


@query("jon_12_existing_log_rows", sql("SELECT o.id, s.sent_at FROM opportunities o LEFT JOIN (SELECT * FROM sent_log WHERE member_id = 2) AS s ON s.opportunity_id = o.id WHERE o.category = 'Grant'", OPP, SENT_SQL))
def existing_log_rows(spark, d):
    log = sent_log(spark, d).where("member_id = 2").select(F.col("opportunity_id").alias("id"), "sent_at")
    return opportunities(spark, d).where("category = 'Grant'").select("id").join(log, "id", "left")


@query("jon_15_title_prefix", sql("SELECT DISTINCT p_partkey, title FROM part, (SELECT DISTINCT title FROM opportunities) AS t WHERE starts_with(title, p_name)"))
def title_prefix(spark, d):
    """Names that titles begin with; all words of a name but its last are an equi-key, so no name meets every title."""
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name").withColumn("key", F.expr("array_join(slice(split(p_name, ' '), 1, size(split(p_name, ' ')) - 1), ' ')"))
    titles = opportunities(spark, d).select("title").distinct()
    keys = F.expr("transform(sequence(0, least(size(split(title, ' ')), 8)), n -> array_join(slice(split(title, ' '), 1, n), ' '))")
    return parts.join(titles.withColumn("key", F.explode(F.array_distinct(keys))), "key").where(F.col("title").startswith(F.col("p_name"))).select("p_partkey", "title").distinct()


@query("jon_16_roster_minus_existing", "SELECT c_custkey, lower(c_name) AS email FROM customer WHERE lower(c_name) NOT IN (SELECT replace(lower(s_name), 'supplier', 'customer') FROM supplier)")
def roster_minus_existing(spark, d):
    there = spark.read.parquet(f"{d}/supplier.parquet").select(F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")).alias("email"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.lower("c_name").alias("email")).join(there, "email", "left_anti")


@query("flt_15_digest_recipients", sql("SELECT member_id, email FROM subscribers WHERE active AND auto_send", SUBSCRIBERS_SQL))
def digest_recipients(spark, d):
    return subscribers(spark, d).where("active AND auto_send").select("member_id", "email")


@query("flt_16_vertical_filter", sql("SELECT id FROM opportunities WHERE contains(verticals, 'Climate') OR contains(verticals, 'Health')"))
def vertical_filter(spark, d):
    return opportunities(spark, d).where(F.arrays_overlap(labels(), F.array(F.lit("Climate"), F.lit("Health")))).select("id")


@query("flt_17_expired_drop", sql("SELECT id FROM opportunities WHERE status <> 'Expired'"))
def expired_drop(spark, d):
    return opportunities(spark, d).where("status <> 'Expired'").select("id")


@query("snk_01_insert_if_new", sql("SELECT title, coalesce(min(id) FILTER (id % 3 = 0), min(id)) AS id FROM opportunities GROUP BY title"))
def insert_if_new(spark, d):
    """A stored table that takes in a third of the listings, then all of them: each title stays as it came first."""
    table = KeyTable(spark, scratch(spark, "keys"), "title string, id long", "title", buckets=8, slots=2)
    rows = opportunities(spark, d).select("title", "id")
    for part in (rows.where("id % 3 = 0"), rows):
        table.insert_new(part, ["id"])
    return table.rows()


@query("snk_04_sent_log_upsert", f"WITH {SENT_SQL}, new AS (SELECT CAST(l_suppkey % 5 + 1 AS BIGINT) AS member_id, l_orderkey AS opportunity_id, max(l_shipdate) AS sent_at FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2) SELECT member_id, opportunity_id, max(sent_at) AS sent_at FROM (SELECT * FROM sent_log UNION ALL SELECT * FROM new) AS x GROUP BY 1, 2")
def sent_log_upsert(spark, d):
    """The stored ledger after further deliveries: one row for each member and listing, the latest time."""
    key = F.concat_ws("/", F.col("member_id").cast("string"), F.col("opportunity_id").cast("string"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag <> 'R'")
    new = lines.groupBy((F.col("l_suppkey") % 5 + 1).cast("long").alias("member_id"), F.col("l_orderkey").alias("opportunity_id")).agg(F.max("l_shipdate").alias("sent_at"))
    ledger = KeyTable(spark, scratch(spark, "keys"), "pair string, member_id long, opportunity_id long, sent_at timestamp", "pair", buckets=8, slots=2)
    ledger.insert_new(sent_log(spark, d).withColumn("pair", key), ["sent_at"])
    ledger.upsert(new.withColumn("pair", key), ["sent_at"])
    return ledger.rows().drop("pair")


@query("snk_05_reminder_log_append", sql(f"SELECT member_id, opportunity_id, days_before FROM reminder_log UNION SELECT member_id, id, days_before FROM ({_DUE}) AS x", OPP, MEMBERS_SQL, SENT_SQL, _REMINDED))
def reminder_log_append(spark, d):
    due = op.due_reminders(opportunities(spark, d), members(spark), sent_log(spark, d), AS_OF, list(REMINDER_DAYS), _reminded(spark, d))
    return _reminded(spark, d).unionByName(due.select("member_id", F.col("id").alias("opportunity_id"), "days_before"))


@query("snk_06_run_rows", "SELECT event_type AS source, min(ts) AS started_at, max(ts) AS finished_at, count(*) AS found FROM events GROUP BY event_type")
def run_rows(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("source")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count(F.lit(1)).alias("found"))


@query("snk_07_latest_by_key", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) AS x WHERE r = 1")
def latest(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.lpad(F.col("event_id").cast("string"), 20, "0").alias("at"))
    return latest_by_key(rows, ["user_id"], "at").select("user_id", "event_id")


@query("snk_08_table_merge", sql("SELECT count(*) AS n FROM (SELECT id FROM opportunities WHERE id % 2 = 0 UNION ALL SELECT min(id) FROM opportunities WHERE status = 'Active' AND title NOT IN (SELECT title FROM opportunities WHERE id % 2 = 0) GROUP BY title) AS x"))
def table_merge(spark, d):
    rows = opportunities(spark, d).withColumn("unique_id", F.sha2("title", 256))
    return ingest.merged(rows.where("id % 2 = 0"), rows.drop("approved"), active_only=True).agg(F.count(F.lit(1)).alias("n"))


@query("snk_09_members_merge", sql("SELECT email, name FROM subscribers UNION ALL SELECT email, name FROM (SELECT concat(replace(replace(lower(s_name), 'supplier', 'customer'), '#', '.'), '@example.org') AS email, s_name AS name FROM supplier) AS s WHERE email NOT IN (SELECT email FROM subscribers)", SUBSCRIBERS_SQL))
def members_merge(spark, d):
    """The members with those of another store whose address they lack: that store calls suppliers what are customers here."""
    address = F.concat(F.replace(F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")), F.lit("#"), F.lit(".")), F.lit("@example.org"))
    other = spark.read.parquet(f"{d}/supplier.parquet").select(address.alias("email"), F.col("s_name").alias("name"))
    return op.members_merged(subscribers(spark, d).select("email", "name"), other)


@query("snk_10_newer_wins", sql("SELECT title, max(id) AS id FROM opportunities GROUP BY title"))
def newer_wins(spark, d):
    rows = opportunities(spark, d).select("title", "id", F.lpad(F.col("id").cast("string"), 20, "0").alias("updated_at"))
    return latest_by_key(rows, ["title"], "updated_at").select("title", "id")


@query("snk_11_delete_by_ids", sql("SELECT id FROM opportunities WHERE id NOT IN (SELECT opportunity_id FROM sent_log)", OPP, SENT_SQL))
def delete_by_ids(spark, d):
    return opportunities(spark, d).select("id").join(sent_log(spark, d).select(F.col("opportunity_id").alias("id")), "id", "left_anti")


@query("snk_13_approval_update", sql("SELECT id, CASE WHEN id IN (1, 2, 3, 4) THEN true ELSE approved END AS approved, CASE WHEN id IN (1, 2, 3, 4) AND NOT approved THEN 'ada' ELSE 'old' END AS approved_by FROM opportunities"))
def approval_update(spark, d):
    rows = opportunities(spark, d).withColumn("approved_at", F.lit(None).cast("timestamp")).withColumn("approved_by", F.lit("old"))
    return ingest.approve(rows, [1, 2, 3, 4], "ada", datetime.datetime(1998, 8, 2)).select("id", "approved", "approved_by")


_FOUND = "regexp_matches(lower(concat_ws(' | ', title, organization, summary, vertical, country, eligibility)), '(^|[^a-z0-9])ring') AND regexp_matches(lower(concat_ws(' | ', title, organization, summary, vertical, country, eligibility)), '(^|[^a-z0-9])ste')"


@query("snk_15_index_upkeep", sql(f"SELECT id FROM (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN concat('Steel ring ', title) ELSE title END AS title) FROM opportunities WHERE id % 7 <> 3) AS x WHERE {_FOUND}"))
def index_upkeep(spark, d):
    """A search through the word index after some titles have changed and some listings have gone, a batch of which comes twice."""
    at, rows = scratch(spark, "index"), opportunities(spark, d)
    search_index.add_batch(at, 1, rows)
    changed = rows.where("id % 5 = 0 AND id % 7 <> 3").withColumn("title", F.concat(F.lit("Steel ring "), "title"))
    for _ in range(2):
        search_index.add_batch(at, 2, changed, rows.where("id % 7 = 3"))
    now = rows.where("id % 7 <> 3").withColumn("title", F.when(F.col("id") % 5 == 0, F.concat(F.lit("Steel ring "), "title")).otherwise(F.col("title")))
    return search_index.searched(now, at, "ring ste").select("id")


@query("snk_15_index_check", sql("SELECT id, CASE WHEN id % 11 = 4 THEN 'missing' ELSE 'extra' END AS why FROM opportunities WHERE id % 11 IN (4, 5)"))
def index_check(spark, d):
    """What the index lacks, and what it holds of listings that are gone."""
    at, rows = scratch(spark, "index"), opportunities(spark, d)
    search_index.add_batch(at, 1, rows.where("id % 11 <> 4"))
    return search_index.stray(rows.where("id % 11 <> 5"), at)


@query("snk_16_member_upsert", sql("SELECT member_id, CASE WHEN member_id % 10 = 3 THEN upper(name) ELSE name END AS name, email FROM subscribers WHERE member_id % 10 <> 4 UNION ALL SELECT 1000000 + s_suppkey, s_name, concat(lower(s_name), '@example.net') FROM supplier", SUBSCRIBERS_SQL))
def member_upsert(spark, d):
    """Members that change their name, leave, or come by their first login: every supplier logs in twice."""
    old = subscribers(spark, d).select("member_id", "name", "email")
    changed = old.where("member_id % 10 = 3").withColumn("name", F.upper("name"))
    left = old.where("member_id % 10 = 4").select("member_id")
    logins = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 1_000_000).alias("member_id"), F.col("s_name").alias("name"), F.concat(F.lower("s_name"), F.lit("@example.net")).alias("email"))
    return op.members_upserted(old, changed, left, logins.union(logins))
