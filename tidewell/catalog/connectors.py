"""Planning of sources, JSON helpers, schedules, exports and snapshots."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import AS_OF
from ..fixtures import index, opportunities, sql
from ..functions import dates
from ..operators import exports, search_index
from ..registry import query
from ..shared import scratch
from ..sources import html as scraped
from ..sources import foreign, items, paged, planning, records
from ..sources.items import pushing


@query("src_04_fetch_with_retry", """WITH t AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 429 ELSE 200 END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT user_id, coalesce(min(n) FILTER (status = 200 AND n <= 3), 9) AS ok, max(status) FILTER (n = 1) AS one, max(status) FILTER (n = 2) AS two FROM t GROUP BY user_id)
SELECT concat('https://u', g.user_id) AS url, CAST(t.event_id AS VARCHAR) AS body, concat_ws(',', CASE WHEN ok > 1 THEN CASE WHEN one = 429 THEN '20' ELSE '2' END END, CASE WHEN ok > 2 THEN CASE WHEN two = 429 THEN '40' ELSE '4' END END) AS waits FROM g LEFT JOIN t ON t.user_id = g.user_id AND t.n = g.ok AND g.ok <= 3""")
def fetch_with_retry(spark, d):
    """How often each source is asked, and how long is waited, when it is busy or broken: what it says each time is the log of its events."""
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 429).otherwise(200)
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return planning.fetched(spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("https://u"), F.col("user_id").cast("string")).alias("url"), nth.alias("nth"), status.alias("status"), F.col("event_id").cast("string").alias("body")))


_SITE = "concat('https://', lower(source_website), '.example.org')"
_CHAIN = "CASE id % 5 WHEN 0 THEN concat({site}, '/rel/', id) WHEN 1 THEN concat({site}, '/calls?page=', id % 7 + 2) WHEN 2 THEN concat({site}, '/older') WHEN 3 THEN concat({site}, '/page/', id % 7 + 2) END"


@query("src_11_generic_paginator", sql(f"SELECT id AS page_id, {_CHAIN.format(site=_SITE)} AS next FROM opportunities"))
def generic_paginator(spark, d):
    """The way to the next page on sites of five kinds: rel=next, a number, an arrow, the URL's own number, none."""
    rows, n = opportunities(spark, d), (F.col("id") % 7 + 1).cast("int")
    kind = F.col("id") % 5
    number = F.concat(F.lit("<ul class='pagination'><li><a class='page' href='/calls?page="), (n + 1).cast("string"), F.lit("'> "), (n + 1).cast("string"), F.lit(" </a></li></ul><a href='#'>Next</a>"))
    html = F.when(kind == 0, F.concat(F.lit("<a href='/older'>»</a><a rel='next' href='/rel/"), F.col("id").cast("string"), F.lit("'>more</a>"))).when(kind == 1, number).when(kind == 2, F.lit("<a href='/older'>Older posts</a><a href='/9'>9</a>")).otherwise("<p>end</p>")
    site = F.concat(F.lit("https://"), F.lower("source_website"), F.lit(".example.org"))
    url = F.when(kind == 3, F.concat(site, F.lit("/page/"), n.cast("string"))).otherwise(F.concat(site, F.lit("/calls")))
    return scraped.next_page(rows.select(F.col("id").alias("page_id"), url.alias("url"), html.alias("html"), n.alias("page"), F.lit(5).alias("found")))


@query("src_11_paginator_template", sql(f"SELECT id AS page_id, CASE WHEN id % 3 > 0 THEN concat('https://x.example.org/list?os=', (id % 7 + 1) * 10) END AS next FROM opportunities"))
def paginator_template(spark, d):
    """A source that counts rows, not pages; a page without items leads nowhere."""
    rows = opportunities(spark, d).select(F.col("id").alias("page_id"), F.lit("https://x.example.org/list").alias("url"), F.lit("").alias("html"), (F.col("id") % 7 + 1).cast("int").alias("page"), (F.col("id") % 3).alias("found"))
    return scraped.next_page(rows, "https://x.example.org/list?os={offset}")


_CONFIG = "(SELECT concat('source_', s_suppkey % 40) AS name, s_name AS template, s_suppkey FROM supplier) AS c"


@query("src_12_plugin_registry", f"SELECT name, arg_min(template, s_suppkey) AS template, count(*) - 1 AS refused FROM {_CONFIG} GROUP BY name UNION ALL SELECT DISTINCT concat('source_', c_custkey % 50), NULL, NULL FROM customer WHERE concat('source_', c_custkey % 50) NOT IN (SELECT name FROM {_CONFIG})")
def plugin_registry(spark, d):
    """Sources by name, which only the first to want it gets, and requested names that nobody has."""
    config = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("source_"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.col("s_name").alias("template"), "s_suppkey")
    requested = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("source_"), (F.col("c_custkey") % 50).cast("string")).alias("name"))
    none = planning.unknown(requested, config).select("name", F.lit(None).cast("string").alias("template"), F.lit(None).cast("long").alias("refused"))
    return planning.registered(config, "s_suppkey").select("name", "template", "refused").unionByName(none)


@query("src_18_axis_validation", sql("SELECT axis, n FROM (SELECT 'category' AS axis, count(*) FILTER (category = 'Grant') AS n, count(*) AS whole FROM opportunities UNION ALL SELECT 'work_type', count(*) FILTER (work_type = 'Research'), count(*) FROM opportunities UNION ALL SELECT 'price', count(*) FILTER (funding_amount LIKE 'USD%'), count(*) FROM opportunities) AS x WHERE n > 0 AND n < whole"))
def axis_validation(spark, d):
    """The axes by which a search really narrows: one that is ignored leaves all rows, one that is misread none."""
    tests = {"category": F.col("category") == "Grant", "language": F.col("id").isNotNull(), "work_type": F.col("work_type") == "Research", "theme": F.col("category") == "grant", "price": F.col("funding_amount").startswith("USD")}
    return planning.useful_axes(opportunities(spark, d), tests)


@query("src_17_cover_by_axes", sql("SELECT category, CASE WHEN big THEN work_type END AS work_type, count(*) AS n FROM (SELECT category, work_type, count(*) OVER (PARTITION BY category) > (SELECT count(*) // 6 FROM opportunities) AS big FROM opportunities) AS x GROUP BY category, CASE WHEN big THEN work_type END"))
def cover_by_axes(spark, d):
    """Searches by category, and by work type where a category has more than a search shows."""
    return planning.cover(opportunities(spark, d), ["category", "work_type"], 6)


@query("src_19_pagination_probe", sql("SELECT source_website AS source, CASE WHEN source_website < 'C' THEN 'page' WHEN source_website < 'H' THEN 'pageNr' END AS field FROM opportunities WHERE source_website < 'H' GROUP BY 1, 2"))
def pagination_probe(spark, d):
    """By which parameter a source turns its pages: all its listings, half of them on each page, under three parameters of which it heeds one or none."""
    rows = opportunities(spark, d).select(F.col("source_website").alias("source"), "id")
    heeds = F.when(F.col("source") < "C", "page").when(F.col("source") < "H", "pageNr")
    asked = rows.select("*", F.posexplode(F.array(*map(F.lit, ("p", "page", "pageNr")))).alias("place", "field"))
    pages = F.when(F.col("field") == heeds, F.array((F.col("id") % 2 + 1).cast("int"))).otherwise(F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")))
    return planning.paging_fields(asked.select("source", "field", "place", F.explode(pages).alias("page"), F.col("id").alias("item")))


@query("src_20_page_size", sql("SELECT source_website AS source, CASE WHEN count(*) >= 3000 THEN 3000 WHEN count(*) >= 300 THEN 300 WHEN count(*) >= 200 THEN 200 WHEN count(*) >= 100 THEN 100 ELSE 50 END AS size FROM opportunities GROUP BY 1"))
def page_sizes(spark, d):
    """The largest page a source gives when asked for ever smaller ones."""
    have = opportunities(spark, d).groupBy(F.col("source_website").alias("source")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    answers = have.select("source", "n", F.explode(F.array(*map(F.lit, (3000, 300, 200, 100, 50)))).alias("asked"))
    return planning.page_sizes(answers.withColumn("got", F.least("n", "asked")))


@query("src_38_url_config", "SELECT concat('n', s_nationkey) AS config, lower(s_name) AS name, concat('https://s', s_suppkey, '.example.org') AS template FROM supplier WHERE s_suppkey % 3 <> 0")
def url_config(spark, d):
    """A JSON map of names and URLs for every nation's sources, with a note and blanks that don't count."""
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    url = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.org")))
    entries = F.collect_list(F.struct(F.lower("s_name").alias("key"), url.alias("value")))
    texts = rows.groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("config")).agg(F.to_json(F.map_concat(F.create_map(F.lit("_help"), F.lit("a name and its URL")), F.map_from_entries(entries))).alias("body"))
    return planning.url_config(texts)


@query("src_03_paged_crawl", sql("SELECT 'saved' AS source, CAST(id // 500 + 1 AS INTEGER) AS page, id, title FROM opportunities"))
def paged_crawl(spark, d):
    """The data source over saved pages of all listings, a partition for each range of pages; they are looked for beyond the end, too."""
    at = scratch(spark, "pages")
    page = F.floor(F.col("id") / 500).cast("int") + 1
    bodies = opportunities(spark, d).groupBy(page.alias("page")).agg(F.to_json(F.collect_list(F.struct("id", "title"))).alias("value"))
    last = bodies.agg(F.max("page")).first()[0] or 0
    whole = spark.range(1, last + 1).select(F.col("id").cast("int").alias("page")).join(bodies, "page", "left").select("page", F.coalesce("value", F.lit("[]")).alias("value"))
    whole.repartition("page").write.partitionBy("page").text(at)
    spark.dataSource.register(paged.PagedSource)
    options = {"template": "https://example.org/list?page={page}", "pages": str(last + 20), "pages_per_partition": "8", "tree": at, "source": "saved", "retries": "1"}
    crawled = paged.to_the_end(spark.read.format("paged").options(**options).load())
    return crawled.select("source", "page", F.explode(F.from_json("body", "array<struct<id: long, title: string>>")).alias("x")).select("source", "page", "x.id", "x.title")


@query("src_37_pushed_filters", sql("SELECT id, title, deadline FROM opportunities WHERE category IN ('Grant', 'RFP') AND deadline >= DATE '1998-01-01' AND title LIKE '%notice%'"))
def pushed_filters(spark, d):
    """Listings of a JSON API that is asked for the categories alone; the other tests are Spark's. The API's answers are saved pages, by category and whole."""
    at, rows = scratch(spark, "api"), opportunities(spark, d).select("id", "title", "category", "deadline")
    keyed = rows.select("*", F.explode(F.array(F.lit("none"), F.when(F.col("category") == "Grant", "one"), F.when(F.col("category").isin("Grant", "RFP"), "both"))).alias("set")).where("set IS NOT NULL")
    placed = keyed.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("set").orderBy("id")) - 1) / 250).cast("int") + 1)
    totals = keyed.groupBy("set").agg(F.count(F.lit(1)).alias("total"))
    bodies = placed.groupBy("set", "page").agg(F.collect_list(F.struct("id", "title", "category", "deadline")).alias("rows")).join(F.broadcast(totals), "set")
    bodies = bodies.select("set", "page", F.to_json(F.struct("total", "rows")).alias("value"))
    folders = {"none": "", "one": "/sectors=Grant", "both": "/sectors=Grant/sectors=RFP"}
    for name, folder in folders.items():  # a folder for each request the API knows
        bodies.where(F.col("set") == name).select("page", "value").repartition("page").write.mode("append").partitionBy("page").text(f"{at}/calls{folder}".replace("/calls", "/first=1"))
    spark.dataSource.register(items.ItemSource)
    options = {"tree": at, "template": "https://example.org/calls?first=1", "parameters": '{"category": "sectors"}', "total": "total", "page_size": "250", "retries": "1"}
    with pushing(spark):
        calls = spark.read.format("items").schema("id long, title string, category string, deadline date").options(**options).load()
        found = calls.where(F.col("category").isin("Grant", "RFP") & (F.col("deadline") >= "1998-01-01") & F.col("title").contains("notice"))
        to = scratch(spark, "api-found")
        found.select("id", "title", "deadline").write.parquet(to)
    return spark.read.parquet(to)


def _answer(items):
    """An answer with a list of objects without ids, and one with."""
    one = F.struct(F.lit(1).alias("n"))
    return F.to_json(F.struct(F.array(one, one, one, one).alias("a"), F.struct(items.alias("c")).alias("b"), F.array(*map(F.lit, (1, 2, 3, 4, 5, 6))).alias("d")))


query("jsn_01_longest_list", sql("SELECT id, CAST(id % 4 + 1 AS BIGINT) AS n FROM opportunities"))(
    lambda spark, d: opportunities(spark, d).select("id", records.longest_list(_answer(F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), lambda k: F.struct(k.alias("id"))))).alias("n"))
)


@query("jsn_03_path_walk", sql("SELECT id, title AS found, region AS changed FROM opportunities"))
def path_walk(spark, d):
    """A value read by its path, and another one put in its place."""
    body = F.to_json(F.struct(F.array(F.struct("title")).alias("a"), F.struct(F.struct("country").alias("y")).alias("x")))
    changed = records.changed_at(body, "x.y.country", F.col("region"))
    return opportunities(spark, d).select("id", F.get_json_object(body, "$.a[0].title").alias("found"), F.get_json_object(changed, "$.x.y.country").alias("changed"))


query("dat_13_schedule", sql("SELECT id, coalesce(CASE id % 5 WHEN 0 THEN date_scraped < TIMESTAMP '1998-08-02 00:00:00' WHEN 1 THEN date_scraped < TIMESTAMP '1998-07-27 00:00:00' WHEN 2 THEN date_scraped < TIMESTAMP '1998-08-01 00:00:00' WHEN 3 THEN date_scraped < TIMESTAMP '1998-01-01 00:00:00' ELSE false END, false) AS due FROM opportunities"))(
    lambda spark, d: opportunities(spark, d).select("id", dates.due(F.element_at(F.array(*map(F.lit, ("daily", "weekly", "monthly", "yearly", "manual"))), (F.col("id") % 5 + 1).cast("int")), F.col("date_scraped"), F.lit(datetime.datetime.combine(AS_OF, datetime.time(9)))).alias("due"))
)


@query("jsn_05_post_fields", sql("SELECT id, concat('R&D – ', title) AS title FROM opportunities"))
def post_fields(spark, d):
    rows = opportunities(spark, d)
    post = F.struct("id", F.struct(F.concat(F.lit("<b>R&amp;D</b> &#8211; "), "title").alias("rendered")).alias("title"))
    answers = rows.select(F.col("id").alias("answer"), F.to_json(F.array(post)).alias("body"))
    return records.wordpress_posts(answers).select("id", "title")


@query("src_25_postback_ids", sql("SELECT id, title FROM opportunities"))
def postback_ids(spark, d):
    """Ids found again by the first 40 characters of a title, as an equi-join on that prefix."""
    rows = opportunities(spark, d)
    links_ = rows.select("id", F.substring(F.concat("id", F.lit("# "), "title"), 1, 40).alias("prefix"))
    return rows.select("title", F.substring(F.concat("id", F.lit("# "), "title"), 1, 40).alias("prefix")).join(links_, "prefix").select("id", "title")


@query("src_25_posted_pages", sql("SELECT id, page, CASE WHEN page < id % 3 + 1 THEN concat('__VIEWSTATE=v', id, '+%26+', page, '&kept=&__EVENTTARGET=grid&__EVENTARGUMENT=Page%24', page + 1) END AS body FROM opportunities, (SELECT unnest(range(1, 4)) AS page) AS p WHERE page <= id % 3 + 1"))
def posted_pages(spark, d):
    """Every board walked to its end, page by page, by what its form posts: the state of a page is of that page alone."""
    last = F.col("id") % 3 + 1

    def html(page):
        links_ = F.concat(*(F.when((page != n) & (last >= n), F.concat(F.lit(f"<a href=\"javascript:__doPostBack('grid','Page${n}')\"> {n} </a>"))).otherwise("") for n in (1, 2, 3)))
        return F.concat(F.lit("<form><input type='hidden' name='__VIEWSTATE' value='v"), F.col("id").cast("string"), F.lit(" &amp; "), page.cast("string"), F.lit("'/><input name='kept' value='' type='hidden'><input type='text' name='q' value='x'>"), links_, F.lit("</form>"))

    rows, page, found = opportunities(spark, d).select("id"), F.lit(1), []
    for n in (1, 2, 3):  # a page is only there for those that were led to it; each form is read once, on the way
        rows = rows.withColumn(f"page{n}", page).withColumn(f"html{n}", F.when(F.col(f"page{n}").isNotNull(), html(F.col(f"page{n}"))))
        rows = rows.withColumn(f"body{n}", scraped.form_body(F.col(f"html{n}"), F.col(f"page{n}"))).drop(f"html{n}")
        found.append(F.when(F.col(f"page{n}").isNotNull(), F.struct(F.lit(n).alias("page"), F.col(f"body{n}").alias("body"))))
        page = F.when(F.col(f"body{n}").isNotNull(), F.regexp_extract(f"body{n}", r"Page%24(\d+)$", 1).cast("int"))
    return rows.select("id", F.inline(F.array_compact(F.array(*found))))


def _cards(spark, d, heading, text):
    """A page for every listing: one card with a heading, a text and a link that says little."""
    card = F.concat(F.lit("<li><h2>"), heading, F.lit("</h2><p>"), text, F.lit("</p><a href='/calls/"), F.col("id").cast("string"), F.lit("'>Learn more</a></li>"))
    return opportunities(spark, d).select(F.col("id").alias("page_id"), F.lit("https://funder.example.org/list").alias("url"), card.alias("html"))


@query("src_28_small_pages", sql("SELECT id, concat('Call for ideas: ', title) AS title, CASE WHEN deadline < DATE '9999-01-01' THEN deadline END AS deadline FROM opportunities WHERE id % 5 = 0 AND id % 3 <> 0 AND length(title) <= 280"))
def small_pages(spark, d):
    """Headings that call for something and are not over, with month-first dates."""
    heading = F.concat(F.when(F.col("id") % 5 == 0, F.concat(F.lit("Call for ideas: "), "title")).otherwise(F.concat(F.lit("News of the year about "), "organization")), F.when(F.col("id") % 3 == 0, " (deadline passed)").otherwise(""))
    closes = F.when(F.col("deadline") < "9999-01-01", F.concat(F.lit("Deadline: "), F.date_format("deadline", "M/d/yyyy"))).otherwise("no date")
    found = scraped.blocks(_cards(spark, d, heading, closes)).where(F.col("title").rlike(r"(?i)\b(call|proposals?)\b") & ~F.col("title").rlike(r"(?i)\bpassed\b"))
    return found.select(F.col("page_id").alias("id"), "title", dates.plain_date(F.nullif("deadline_raw", F.lit("")), dayfirst=False).alias("deadline"))


@query("src_29_link_pattern", sql("SELECT id, concat('https://funder.example.org/calls/', id) AS url, coalesce(strftime(deadline, '%-d %B %Y'), '') AS deadline_raw FROM opportunities WHERE length(concat('Funding for ', title)) BETWEEN 18 AND 300"))
def link_pattern(spark, d):
    """Links to calls, each with the deadline of the nearest block around it."""
    closes = F.coalesce(F.date_format("deadline", "'Closing date: 'd MMMM yyyy"), F.lit("none"))
    found = scraped.blocks(_cards(spark, d, F.concat(F.lit("Funding for "), "title"), closes)).where(F.col("url").rlike(r"/calls/\d+$"))
    return found.select(F.col("page_id").alias("id"), "url", "deadline_raw")


@query("src_30_fund_directory", sql("SELECT id, id % 3 = 0 AS assume_active FROM opportunities WHERE length(concat('Fund of ', title)) BETWEEN 18 AND 300"))
def fund_directory(spark, d):
    """Funds whose own words say whether they are open."""
    says = F.when(F.col("id") % 3 == 0, "Now open for applications from everyone everywhere").when(F.col("id") % 3 == 1, "This fund is closed for the rest of the year").otherwise("Paused until spring comes and accepting none")
    found = scraped.blocks(_cards(spark, d, F.concat(F.lit("Fund of "), "title"), says))
    return found.select(F.col("page_id").alias("id"), (F.col("summary").rlike(r"(?i)\b(open|accepting)\b") & ~F.col("summary").rlike(r"(?i)\b(closed|paused)\b")).alias("assume_active"))


@query("src_35_foreign_scan", sql("SELECT id, title, category, deadline, source_website FROM opportunities WHERE category = 'Grant' AND id < 20000 AND (deadline IS NULL OR deadline < DATE '1999-01-01')"))
def foreign_scan(spark, d):
    """Listings of a second store with a schema of its own, in ours; the tests that its columns allow are made in its scan."""
    at = scratch(spark, "foreign")
    theirs = opportunities(spark, d).select(F.col("id").alias("call_no"), F.col("title").alias("heading"), F.col("category").alias("kind"), F.date_format("deadline", "dd/MM/yyyy").alias("closes_on"), F.upper("source_website").alias("site"))
    theirs.write.parquet(at)
    ours = foreign.mapped(spark.read.parquet(at), {"id": "call_no", "title": "heading", "category": "kind", "deadline": F.to_date("closes_on", "dd/MM/yyyy"), "source_website": "site"})
    return ours.where("category = 'Grant' AND id < 20000 AND (deadline IS NULL OR deadline < DATE '1999-01-01')").select("id", "title", "category", "deadline", "source_website")


@query("snk_02_csv_export", sql("SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in exports.COLUMNS) + " FROM opportunities"))
def csv_export(spark, d):
    """All columns in export order, written with a header and the mark that spreadsheets look for, and read back."""
    at = scratch(spark, "export")
    exports.write_csv(opportunities(spark, d), at)
    return exports.read_csv(spark, at)


@query("snk_12_snapshot", sql("SELECT count(*) AS n, count(*) FILTER (WHERE status = 'Active') AS kept FROM opportunities"))
def snapshot(spark, d):
    """A versioned copy taken before rows are dropped: the copy still has them."""
    at = scratch(spark, "snapshot")
    opportunities(spark, d).write.parquet(f"{at}/version=1")
    spark.read.parquet(f"{at}/version=1").where("status = 'Active'").write.parquet(f"{at}/version=2")
    after = spark.read.parquet(f"{at}/version=2").agg(F.count(F.lit(1)).alias("kept"))
    return spark.read.parquet(f"{at}/version=1").agg(F.count(F.lit(1)).alias("n")).crossJoin(after)  # one row each


@query("jon_07_search_semi_join", sql("SELECT id FROM opportunities WHERE regexp_matches(lower(concat_ws(' | ', title, organization, summary, vertical, country, eligibility)), '(^|[^a-z0-9])ring')"))
def search_semi_join(spark, d):
    """Rows whose postings in the word index hold a word that begins with the term."""
    return search_index.narrowed(opportunities(spark, d).select("id"), index(spark, d), "ring").select("id")


@query("jon_14_source_progress", "SELECT r.source, pages, last, found FROM (SELECT DISTINCT event_type AS source FROM events) AS r LEFT JOIN (SELECT event_type AS source, count(DISTINCT date_trunc('hour', ts)) AS pages, max(event_id) AS last, count(*) AS found FROM events WHERE value > 0 GROUP BY 1) AS p ON p.source = r.source")
def source_progress(spark, d):
    """Every registered source with what its crawl has done so far, nothing where it has not begun."""
    events = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "source")
    done = events.where("value > 0").groupBy("source").agg(F.countDistinct(F.date_trunc("hour", "ts")).alias("pages"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("found"))
    return events.select("source").distinct().join(done, "source", "left")


@query("srt_05_matching_order", sql("SELECT id, deadline FROM opportunities WHERE category = 'Grant' ORDER BY deadline ASC NULLS FIRST, id LIMIT 100"))
def matching_order(spark, d):
    return opportunities(spark, d).where("category = 'Grant'").select("id", "deadline").orderBy(F.asc_nulls_first("deadline"), "id").limit(100)


