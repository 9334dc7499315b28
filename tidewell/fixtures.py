"""The listing tables, derived from the driver's tables by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import search_index
from .shared import scratch

OPPORTUNITY = {
    "id": "o_orderkey",
    "title": "concat(p_name, CASE o_orderkey % 9 WHEN 0 THEN ' baseline study' WHEN 1 THEN ' request for proposals' WHEN 2 THEN ' tender for supply of equipment' WHEN 3 THEN ' grants programme' WHEN 4 THEN ' impact evaluation' WHEN 5 THEN ' call for proposals' WHEN 6 THEN ' fellowship' WHEN 7 THEN ' implementation and delivery' ELSE ' notice' END)",
    "organization": "c_name",
    "country": "n_name",
    "region": "r_name",
    "funding_type": "p_brand",
    "vertical": "lower(p_type)",
    "verticals": "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'Health' WHEN 2 THEN 'Health, Education' ELSE 'Education, Climate, Gender' END",
    "work_type": "CASE o_orderkey % 3 WHEN 0 THEN 'Research' WHEN 1 THEN 'Implementation' ELSE '' END",
    "study_type": "CASE o_orderkey % 9 WHEN 0 THEN 'Baseline' WHEN 4 THEN 'Evaluation' ELSE '' END",
    "category": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Grant' WHEN '2-HIGH' THEN 'RFP' WHEN '3-MEDIUM' THEN 'Tender' WHEN '4-NOT SPECIFIED' THEN 'Proposal' ELSE 'Other' END",
    "deadline": "CASE WHEN o_orderkey % 10 = 0 THEN CAST(NULL AS DATE) WHEN o_orderkey % 211 = 1 THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) END",
    "website": "concat('https://', lower(c_mktsegment), '.example.org')",
    "opportunity_url": "CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN concat('https://', lower(c_mktsegment), '.example.org/grants/') WHEN o_orderkey % 17 = 0 THEN concat('https://', lower(c_mktsegment), '.example.org/view/12,13') ELSE concat('https://', lower(c_mktsegment), '.example.org/calls/', CAST(o_orderkey AS STRING)) END",
    "summary": "concat('A ', p_name, ' of ', lower(p_type), ' kind. Grants up to USD ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' for data collection.')",
    "location": "n_name",
    "eligibility": "CASE WHEN o_orderkey % 4 = 0 THEN 'registered bodies' ELSE '' END",
    "funding_amount": "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('USD ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)) END",
    "status": "CASE WHEN o_orderkey % 50 = 7 THEN 'Active' WHEN o_orderkey % 10 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1998-08-02' THEN 'Active' ELSE 'Expired' END",
    "source_website": "c_mktsegment",
    "date_scraped": "CASE WHEN o_orderkey % 97 = 0 THEN TIMESTAMP '1998-08-02 08:00:00' ELSE CAST(o_orderdate AS TIMESTAMP) END",
    "approved": "o_orderstatus = 'F'",
}
_FROM = """orders
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    JOIN (SELECT l_orderkey, min(l_partkey) AS partkey FROM lineitem GROUP BY l_orderkey) AS first_line ON o_orderkey = l_orderkey
    JOIN part ON partkey = p_partkey"""

#: Subscribers: who they are and what they want (empty: everything).
MEMBERS = [
    (1, "Ada", "ada@example.org", True, True, "ring, bolt", "", ""),
    (2, "Ben", "ben@example.org", True, True, "", "Grant, RFP", "Health"),
    (3, "Cleo", "cleo@example.org", True, False, "widget", "Tender", ""),
    (4, "Dev", "dev@example.org", False, True, "", "", ""),
    (5, "Eve", "eve@example.org", True, True, "gear", "Nonsense", "Education, Climate"),
]
MEMBER_COLUMNS = "member_id long, name string, email string, active boolean, auto_send boolean, keywords string, categories string, verticals string"


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str], str] = {}


def store(spark, sf_dir: str) -> None:
    """Writes the listings once, as a deployment keeps them, in a file for each core at least; queries of this application read them from then on."""
    to = scratch(spark, "listings")
    opportunities(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "id").write.parquet(to)
    _STORED[spark.sparkContext.applicationId, sf_dir] = to


def opportunities(spark, sf_dir: str) -> DataFrame:
    if stored := _STORED.get((spark.sparkContext.applicationId, sf_dir)):
        return spark.read.parquet(stored)
    orders, customer, nation, region, lineitem, part = (_read(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region", "lineitem", "part"))
    first = lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("partkey"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = joined.join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("partkey") == F.col("p_partkey"))
    return joined.select(*(F.expr(e).alias(x) for x, e in OPPORTUNITY.items()))


_INDEXED: dict[tuple[str, str], str] = {}


def index(spark, sf_dir: str) -> str:
    """The word index of the listings, built once an application, as a deployment keeps it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXED:
        at = scratch(spark, "index")
        search_index.add_batch(at, 1, opportunities(spark, sf_dir))
        _INDEXED[key] = at
    return _INDEXED[key]


def members(spark, sf_dir: str | None = None) -> DataFrame:
    return spark.createDataFrame(MEMBERS, MEMBER_COLUMNS)


#: Every customer as a subscriber: by name or the name of another, with categories for some and labels for others.
SUBSCRIBER = {
    "member_id": "c_custkey",
    "name": "c_name",
    "email": "concat(replace(lower(c_name), '#', '.'), CASE WHEN c_custkey % 4 = 0 THEN '@example.com' ELSE '@example.org' END)",
    "active": "c_custkey % 7 <> 0",
    "auto_send": "c_acctbal >= 0",
    "keywords": "CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat(upper(c_name), ', ', 'no such word ', c_custkey) ELSE concat('nothing ', c_custkey % 11, ', ', c_name, ' ,,') END",
    "categories": "CASE WHEN c_custkey % 5 = 0 THEN 'Grant, RFP' WHEN c_custkey % 5 = 1 THEN 'Nonsense' ELSE '' END",
    "verticals": "CASE WHEN c_custkey % 6 = 0 THEN 'health' WHEN c_custkey % 6 = 1 THEN 'Educ, climate' ELSE '' END",
}


def subscribers(spark, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(*(F.expr(e).alias(x) for x, e in SUBSCRIBER.items()))


def sent_log(spark, sf_dir: str) -> DataFrame:
    """(member_id, opportunity_id, sent_at): what was sent before, from returned lines."""
    lines = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return lines.groupBy((F.col("l_suppkey") % 5 + 1).cast("long").alias("member_id"), F.col("l_orderkey").alias("opportunity_id")).agg(F.max("l_shipdate").alias("sent_at"))


def pages(spark, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages")


def crawl(spark, sf_dir: str) -> DataFrame:
    """(source, page, item): a crawl in page order, from events: a source is a kind of event, a page an hour."""
    events = _read(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("source"), F.date_trunc("hour", "ts").alias("page"), F.col("user_id").alias("item"), "event_id")


OPP = f"opportunities AS (SELECT {', '.join(f'{e} AS {x}' for x, e in OPPORTUNITY.items())} FROM {_FROM})"
_VALUES = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x) for x in row) + ")" for row in MEMBERS)
MEMBERS_SQL = f"members AS (SELECT * FROM (VALUES {_VALUES}) AS m(member_id, name, email, active, auto_send, keywords, categories, verticals))"
SUBSCRIBERS_SQL = f"subscribers AS (SELECT {', '.join(f'{e} AS {x}' for x, e in SUBSCRIBER.items())} FROM customer)"
SENT_SQL = "sent_log AS (SELECT CAST(l_suppkey % 5 + 1 AS BIGINT) AS member_id, l_orderkey AS opportunity_id, max(l_shipdate) AS sent_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"
CRAWL_SQL = "crawl AS (SELECT event_type AS source, date_trunc('hour', ts) AS page, user_id AS item, event_id FROM events)"


def sql(body: str, *tables: str) -> str:
    """An oracle over the derived tables (by default the listings)."""
    return f"WITH {', '.join(tables or (OPP,))} {body}"
