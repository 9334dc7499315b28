"""Readers and extractors over saved pages and JSON answers, sinks, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF
from ..fixtures import crawl, opportunities, pages, sql
from ..functions import dates, text
from ..operators import digests, exports
from ..operators.summaries import first_seen
from ..registry import query
from ..sources import guards, html, paged, planning, records


@query("src_06_url_loop_guard", "WITH seen AS (SELECT user_id AS source, event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events), ends AS (SELECT source, min(event_id) AS e FROM seen WHERE n = 2 GROUP BY source) SELECT s.source, s.event_id FROM seen s LEFT JOIN ends x ON x.source = s.source WHERE x.e IS NULL OR s.event_id < x.e")
def url_loop_guard(spark, d):
    """Requests of every source until it sends one again."""
    requests = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("source"), "event_id", F.concat_ws(" ", "event_type", "props").alias("request"))
    return guards.until_repeat(requests, "source", F.col("request"), "event_id").select("source", "event_id")


_FINGERPRINTS = "WITH crawl AS (SELECT event_type AS source, date_trunc('hour', ts) AS page, event_id FROM events) SELECT source, page, sha256(string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY CAST(event_id AS VARCHAR))) AS fingerprint FROM crawl GROUP BY source, page"


@query("src_07_repeated_content_guard", _FINGERPRINTS)
def repeated_content(spark, d):
    items = crawl(spark, d).select("source", "page", F.col("event_id").cast("string").alias("url"), F.lit("").alias("title"))
    return html.page_fingerprint(items)


@query("src_08_empty_page_terminator", "WITH p AS (SELECT user_id AS source, date_trunc('hour', ts) AS page, count(*) FILTER (WHERE event_type <> 'error') AS found FROM events GROUP BY 1, 2), ends AS (SELECT source, min(page) AS e FROM p WHERE found = 0 GROUP BY source) SELECT p.source, page, found FROM p LEFT JOIN ends x ON x.source = p.source WHERE x.e IS NULL OR page < x.e")
def empty_page(spark, d):
    """Pages (a source's hours) before the first that brings nothing but errors."""
    events = spark.read.parquet(f"{d}/events.parquet")
    found = events.groupBy(F.col("user_id").alias("source"), F.date_trunc("hour", "ts").alias("page")).agg(F.count_if(F.col("event_type") != "error").alias("found"))
    return guards.until_empty(found)


_SITE = "concat('https://', lower(source_website), '.example.org')"


def _site():
    return F.concat(F.lit("https://"), F.lower("source_website"), F.lit(".example.org"))


@query("src_09_next_page", sql(f"SELECT id AS page_id, CASE id % 4 WHEN 0 THEN concat({_SITE}, '/rel/', id) WHEN 1 THEN concat({_SITE}, '/calls/older-', id) WHEN 2 THEN 'https://else.example.org/x' END AS next FROM opportunities"))
def next_page(spark, d):
    """The link marked rel=next, else the one labelled next; relative, rooted and whole URLs."""
    n = F.col("id").cast("string")
    body = F.when(F.col("id") % 4 == 0, F.concat(F.lit("<a href='/no'>Next</a><link rel='next' href='/rel/"), n, F.lit("'>"))).when(F.col("id") % 4 == 1, F.concat(F.lit("<a class='x' href='older-"), n, F.lit("'> Next </a>")))
    body = body.when(F.col("id") % 4 == 2, F.lit("<a href='https://else.example.org/x'>»</a>")).otherwise("<a href='/a'>Home</a>")
    return html.next_link(opportunities(spark, d).select(F.col("id").alias("page_id"), F.concat(_site(), F.lit("/calls/list")).alias("url"), body.alias("html")))


def _listing_pages(spark, d):
    """A saved page for every listing: furniture, then a block with heading, text, and a link that says little or all."""
    says = F.when(F.col("id") % 2 == 0, F.lit("Learn more")).otherwise(F.col("title"))
    closes = F.when(F.col("deadline").isNotNull() & (F.col("id") % 3 > 0), F.concat(F.lit("Deadline: "), F.date_format("deadline", "d MMMM yyyy"), F.lit(". "))).otherwise("")
    block = F.concat(F.lit("<article class='card'><h3>"), "title", F.lit("</h3><p>"), closes, "summary", F.lit("</p><a href='/calls/"), F.col("id").cast("string"), F.lit("'>"), says, F.lit("</a></article>"))
    body = F.concat(F.lit("<html><nav><a href='/about'>About our organisation and its history</a></nav><div>"), block, F.lit("<a href='#top'>Back</a></div></html>"))
    return opportunities(spark, d).select(F.col("id").alias("page_id"), F.concat(_site(), F.lit("/list")).alias("url"), body.alias("html"))


_CLOSES = "CASE WHEN deadline IS NOT NULL AND id % 3 > 0 THEN strftime(deadline, '%-d %B %Y') ELSE '' END"
_BLOCK = f"concat(title, ' ', CASE WHEN {_CLOSES} = '' THEN '' ELSE concat('Deadline: ', {_CLOSES}, '. ') END, summary, ' ', CASE WHEN id % 2 = 0 THEN 'Learn more' ELSE title END)"


@query("src_13_html_listings", sql(f"SELECT id AS page_id, title, concat({_SITE}, '/calls/', id) AS url, {_CLOSES} AS deadline_raw, CASE WHEN length({_BLOCK}) > length(title) + 40 THEN {_BLOCK} ELSE '' END AS summary, {_CLOSES} = '' AS assume_active FROM opportunities WHERE length(title) BETWEEN 18 AND 300"))
def html_listings(spark, d):
    """Listings out of blocks: the link's title or the heading's, the deadline and the text around it."""
    return html.blocks(_listing_pages(spark, d)).drop("place")


@query("src_13_site_anchors", sql(f"SELECT id AS page_id, title, concat({_SITE}, '/calls/', id) AS url FROM opportunities WHERE id % 2 = 1 AND length(title) BETWEEN 18 AND 300 UNION ALL SELECT id, 'About our organisation and its history', concat({_SITE}, '/about') FROM opportunities"))
def site_anchors(spark, d):
    """Anchors of the same site whose own text could be a title."""
    return html.listings(_listing_pages(spark, d)).select("page_id", "title", "url")


_TAG = "(?is)<a\\s[^>]*href=[\"''][^\"'']+[\"''][^>]*>.*?</a>"
_PLAIN = "regexp_replace(tag, '(?s)<[^>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#8217;", "’"), ("&#8211;", "–"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"


@query("src_13_anchors", f"SELECT page_id, CAST(place AS INTEGER) - 1 AS place, url, regexp_extract(tag, '(?is)href=[\"'']([^\"'']+)[\"'']', 1) AS href, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS label FROM (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS place FROM (SELECT page_id, url, regexp_extract_all(html, '{_TAG}') AS tags FROM pages) AS t) AS x")
def html_anchors(spark, d):
    return html.anchors(pages(spark, d))


@query("src_14_title_cleaner", sql("SELECT id, title AS value FROM opportunities"))
def title_cleaner(spark, d):
    return opportunities(spark, d).select("id", text.cleaned_title(F.concat(F.lit("Title:  "), "title")).alias("value"))


def _answers(spark, d):
    rows = opportunities(spark, d)
    post = F.struct("id", F.col("opportunity_url").alias("link"), F.struct(F.concat("title", F.lit(" ("), "country", F.lit(")")).alias("rendered")).alias("title"), F.struct(F.concat(F.lit("<p>"), "summary", F.lit("</p>")).alias("rendered")).alias("excerpt"))
    return rows.groupBy(F.floor(F.col("id") / 50).alias("answer")).agg(F.to_json(F.sort_array(F.collect_list(post))).alias("body"))


@query("src_15_wordpress_posts", sql("SELECT id // 50 AS answer, id, concat(title, ' (', country, ')') AS title, opportunity_url AS url, summary, '' AS country FROM opportunities"))
def wordpress_posts(spark, d):
    return records.wordpress_posts(_answers(spark, d)).withColumn("country", F.when(F.col("country").rlike("[0-9]"), F.col("country")).otherwise(F.lit("")))


@query("src_16_discovered_records", sql("SELECT id // 50 AS answer, opportunity_url AS link FROM opportunities"))
def discovered_records(spark, d):
    wrapped = _answers(spark, d).select("answer", F.concat(F.lit('{"meta":{"n":1},"payload":{"rows":'), "body", F.lit("}}")).alias("body"))
    return records.records(wrapped, {"link": ["link"]})


@query("src_21_label_value_map", sql("SELECT id, country, category FROM opportunities"))
def label_value_map(spark, d):
    body = F.concat(F.lit("<dl><dt>Country:</dt><dd> "), "country", F.lit("</dd><dt>Kind</dt><dd><b>"), "category", F.lit("</b></dd></dl>"))
    fields = opportunities(spark, d).select("id", html.fields(body).alias("f"))
    return fields.select("id", F.col("f")["country"].alias("country"), F.col("f")["kind"].alias("category"))


query("jsn_04_label_value_map", sql("SELECT id, country AS value FROM opportunities"))(
    lambda spark, d: opportunities(spark, d).select("id", F.try_element_at(html.fields(F.concat(F.lit("<dt>Country</dt><dd>"), "country", F.lit("</dd>"))), F.lit("country")).alias("value"))
)
query("jsn_02_key_needle", sql("SELECT id, region AS value FROM opportunities"))(
    lambda spark, d: opportunities(spark, d).select("id", records.key_needle(F.create_map(F.lit("regionId"), F.lit("9"), F.lit("mainRegion"), F.col("region")), "region").alias("value"))
)
@query("jsn_06_settings_merge", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS schedule, '10,7' AS days, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS source FROM customer")
def settings_merge(spark, d):
    """Stored settings of every customer with a patch laid over: new keys added, others kept."""
    old = F.create_map(F.lit("schedule"), F.lit("weekly"), F.lit("days"), F.lit("10,7"))
    daily = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("schedule"), F.lit("daily"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    patch = F.when(F.col("c_custkey") % 3 == 0, F.map_concat(daily, F.create_map(F.lit("source"), F.col("c_mktsegment")))).otherwise(daily)
    merged = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", records.merged_settings(old, patch).alias("m"))
    return merged.select("c_custkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("schedule", "days", "source")))


@query("src_22_distinct_new", "WITH item AS (SELECT event_type AS source, user_id AS item, date_trunc('hour', ts) AS page FROM events), first AS (SELECT source, item, min(page) AS page FROM item GROUP BY 1, 2), p AS (SELECT source, page, count(*) AS found FROM item GROUP BY 1, 2), s AS (SELECT source, page, count(*) AS saved FROM first GROUP BY 1, 2), j AS (SELECT p.source, p.page, found, coalesce(saved, 0) AS saved, row_number() OVER (PARTITION BY p.source ORDER BY p.page) AS n FROM p LEFT JOIN s ON s.source = p.source AND s.page = p.page), g AS (SELECT *, sum(CASE WHEN saved = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY page) AS grp FROM j), k AS (SELECT *, sum(CASE WHEN saved = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, grp ORDER BY page) AS streak FROM g), e AS (SELECT source, min(n) AS last FROM k WHERE streak >= 5 GROUP BY source) SELECT k.source, k.page, k.saved AS fresh FROM k LEFT JOIN e ON e.source = k.source WHERE e.last IS NULL OR k.n <= e.last")
def distinct_new(spark, d):
    """New items of every page, until five pages in a row bring none."""
    return guards.fresh_pages(crawl(spark, d), 5).select("source", "page", F.col("saved").alias("fresh"))


query("set_05_first_seen_union", "SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'view')")(lambda spark, d: first_seen(spark.read.parquet(f"{d}/events.parquet").where("event_type IN ('click', 'view')"), "user_id", ["event_id"]).select("user_id"))


@query("src_23_labelled_fields", sql("SELECT id, country, category AS kind FROM opportunities"))
def labelled_fields(spark, d):
    page = F.concat(F.lit("Status: open Country: "), "country", F.lit(" Kind: "), "category", F.lit(" Posted: 3 May 2026"))
    until = ["Status", "Country", "Kind", "Posted"]
    return opportunities(spark, d).select("id", html.field_of(page, "Country", until).alias("country"), html.field_of(page, "Kind", until).alias("kind"))


@query("src_24_cards", sql("SELECT id AS page_id, CASE WHEN id % 2 = 0 THEN title ELSE concat('Heading of ', title) END AS title, concat('/t/', id) AS href, CASE WHEN id % 2 = 0 THEN country END AS country, CASE WHEN id % 2 = 0 THEN category END AS kind, CASE id % 3 WHEN 0 THEN '£' || (id % 900 + 100) || 'k' WHEN 1 THEN '£' || (id % 90 + 10) || 'k+' ELSE '' END AS size FROM opportunities"))
def cards(spark, d):
    """Cards with a definition list, and cards that only have a heading; sizes such as £50k+ anywhere in them."""
    n = F.col("id")
    size = F.when(n % 3 == 0, F.concat(F.lit("£"), (n % 900 + 100).cast("string"), F.lit("k"))).when(n % 3 == 1, F.concat(F.lit("£"), (n % 90 + 10).cast("string"), F.lit("k+"))).otherwise("no size")
    link = F.concat(F.lit("<a href='/t/"), n.cast("string"), F.lit("'>"))
    listed = F.concat(F.lit("<article><h2>"), link, "title", F.lit("</a></h2><dl><dt>Country:</dt><dd>"), "country", F.lit("</dd><dt>Kind</dt><dd>"), "category", F.lit("</dd></dl><p>"), size, F.lit("</p></article>"))
    headed = F.concat(F.lit("<h3>"), link, F.lit("Heading of "), "title", F.lit("</a></h3><p>"), size, F.lit("</p><hr>"))
    rows = opportunities(spark, d).select(n.alias("page_id"), F.when(n % 2 == 0, listed).otherwise(headed).alias("html"))
    found = html.cards(rows)
    return found.select("page_id", "title", "href", *(F.try_element_at("fields", F.lit(k)).alias(k) for k in ("country", "kind")), "size")


@query("src_24_parsed_cards", sql("SELECT id AS page_id, title, concat('/t/', id) AS href, category AS kind FROM opportunities"))
def parsed_cards(spark, d):
    """The same kind of card by the standard library's parser."""
    body = F.concat(F.lit("<article><h2>"), "title", F.lit("</h2><a href='/t/"), F.col("id").cast("string"), F.lit("'>more</a><span class='kind'>"), "category", F.lit("</span></article>"))
    found = html.parsed_cards(opportunities(spark, d).select(F.col("id").alias("page_id"), body.alias("html")))
    return found.select("page_id", F.col("fields")["h2"].alias("title"), F.col("fields")["href"].alias("href"), F.col("fields")["kind"].alias("kind"))


@query("src_26_smallest_next_number", sql("SELECT id, CAST(id % 7 + 1 AS INTEGER) AS next_page FROM opportunities"))
def smallest_next_number(spark, d):
    numbers = F.concat(*(F.concat(F.lit("<a href='?page="), (F.col("id") % 7 + k).cast("string"), F.lit("'>")) for k in (3, 0, 1)))
    rows = opportunities(spark, d).select("id", (F.col("id") % 7).cast("int").alias("at"), numbers.alias("html"))
    return html.page_numbers(rows.withColumnRenamed("id", "page_id"), F.col("at")).withColumnRenamed("page_id", "id")


_GAP = "funding_amount = '' OR deadline IS NULL"


_MISSING = "id % 3 = 0"


@query("src_31_detail_enrichment", sql(f"SELECT id, CASE WHEN {_MISSING} THEN coalesce(strftime(deadline, '%-d %B %Y'), '') ELSE 'given' END AS deadline_raw, CASE WHEN funding_amount = '' THEN concat('up to ', regexp_extract(summary, 'USD [0-9]+')) ELSE funding_amount END AS funding_amount, CASE WHEN {_MISSING} THEN 'Green Trust' ELSE organization END AS organization, CASE WHEN {_MISSING} THEN concat('The Green Trust is inviting applications. ', summary, CASE WHEN deadline IS NULL THEN '' ELSE concat(' Deadline: ', strftime(deadline, '%-d %B %Y')) END, ' for everyone who reads this page to its very end and then some more of it') ELSE summary END AS summary FROM opportunities"))
def detail_enrichment(spark, d):
    """Deadline, amount, organisation and summary from a listing's own page, each where it is missing."""
    rows = opportunities(spark, d)
    closes = F.when(F.col("deadline").isNull(), "").otherwise(F.concat(F.lit(" Deadline: "), F.date_format("deadline", "d MMMM yyyy")))
    page = F.concat(F.lit("<nav>Home</nav><p>The Green Trust is inviting applications.</p><p>"), "summary", F.lit("</p><script>x</script>"), closes, F.lit(" for everyone who reads this page to its very end and then some more of it"))
    detail = rows.select("id", page.alias("html"))
    gap = F.expr(_MISSING)
    known = rows.select("id", "title", F.when(gap, "").otherwise("given").alias("deadline_raw"), "funding_amount", F.when(gap, "").otherwise(F.col("organization")).alias("organization"), F.when(gap, "").otherwise(F.col("summary")).alias("summary"))
    return html.enriched(known, detail).select("id", "deadline_raw", "funding_amount", "organization", "summary")


@query("src_32_enrichment_targets", sql(f"SELECT id, source_website FROM (SELECT id, source_website, row_number() OVER (PARTITION BY source_website ORDER BY id) AS r FROM opportunities WHERE {_GAP}) AS x WHERE r <= 20"))
def enrichment_targets(spark, d):
    from pyspark.sql import Window

    gaps = opportunities(spark, d).where(_GAP).withColumn("r", F.row_number().over(Window.partitionBy("source_website").orderBy("id")))
    return gaps.where("r <= 20").select("id", "source_website")


@query("src_33_counter_from_page", sql("SELECT id, CAST(id AS BIGINT) AS experts FROM opportunities"))
def counter_from_page(spark, d):
    page = F.concat(F.lit("<p>There are <b>"), F.format_number("id", 0), F.lit("</b> experts here</p>"))
    return opportunities(spark, d).select("id", F.replace(F.regexp_extract(text.html_text(page), r"([\d,]+)\s+experts", 1), F.lit(","), F.lit("")).cast("long").alias("experts"))


@query("src_34_roster_reader", "SELECT c_name AS name, concat(lower(c_name), '@example.org') AS email FROM customer WHERE c_custkey % 10 <> 0")
def roster_reader(spark, d):
    line = F.concat(F.when(F.col("c_custkey") % 10 == 0, "# ").otherwise(""), "c_name", F.lit(", "), F.lower("c_name"), F.lit("@example.org"))
    lines = spark.read.parquet(f"{d}/customer.parquet").select(line.alias("value")).where(~F.col("value").startswith("#"))
    return lines.select(F.trim(F.split("value", ",")[0]).alias("name"), F.trim(F.split("value", ",")[1]).alias("email"))


@query("src_36_result_shape", sql("SELECT id, CASE id % 3 WHEN 0 THEN 'results' WHEN 1 THEN 'items' END AS holder FROM opportunities"))
def result_shape(spark, d):
    """Where an answer keeps its rows, for answers of three kinds: the last has too few."""
    row = F.struct("title")
    few, many = F.array(row), F.array(row, row, row)
    body = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(few.alias("items"), many.alias("results")))).when(F.col("id") % 3 == 1, F.to_json(F.struct(many.alias("items")))).otherwise(F.to_json(F.struct(few.alias("data"))))
    return opportunities(spark, d).select("id", records.shape(body).alias("holder"))


@query("src_37_source_predicate", sql("SELECT id, concat('https://example.org/t?sectors=', category, CASE WHEN region = '' THEN '' ELSE concat('&region=', replace(region, ' ', '+')) END, CASE WHEN work_type = '' THEN '' ELSE concat('&kind=', work_type) END, '&pageNr=', CAST(id % 7 + 1 AS VARCHAR)) AS url FROM opportunities"))
def source_predicate(spark, d):
    """What a listing's fields ask of a source, as its own query parameters; blanks are left out."""
    wanted = {"sectors": F.col("category"), "region": F.col("region"), "kind": F.col("work_type"), "pageNr": (F.col("id") % 7 + 1).cast("string")}
    return opportunities(spark, d).select("id", records.filtered_url("https://example.org/t", wanted).alias("url"))


@query("src_10_config_factory", "SELECT lower(c_mktsegment) AS name, page, CASE WHEN c_mktsegment < 'D' THEN concat('https://', lower(c_mktsegment), '.example.org/?page=', page) ELSE concat('https://', lower(c_mktsegment), '.example.org/', (page - 1) * 20) END AS url FROM (SELECT DISTINCT c_mktsegment FROM customer) AS s, (VALUES (1), (2), (3)) AS p(page)")
def config_factory(spark, d):
    """Sources of a configuration table, each with the URLs of its first pages."""
    name = F.lower("c_mktsegment")
    template = F.concat(F.lit("https://"), name, F.when(F.col("c_mktsegment") < "D", F.lit(".example.org/")).otherwise(F.lit(".example.org/{offset}")))
    return planning.first_pages(spark.read.parquet(f"{d}/customer.parquet").select("c_mktsegment").distinct().select(name.alias("name"), template.alias("template")), 3)


_HALVED = (
    "WITH RECURSIVE v AS (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders WHERE isfinite(CAST(o_totalprice AS DOUBLE))), "
    "s AS (SELECT count(*) // 16 AS reach, greatest(1048576.0::DOUBLE, coalesce(pow(2::DOUBLE, floor(log2(nullif(max(abs(x)), 0))) + 1), 0)) AS span, coalesce(min(x) < 0, false) AS below FROM v), "
    "r AS (SELECT CASE WHEN below THEN -span ELSE 0 END AS lo, span AS hi, count(x) AS n, min(x) AS a, max(x) AS b FROM s LEFT JOIN v ON true GROUP BY ALL "
    "UNION ALL SELECT h.lo, h.hi, count(v.x), min(v.x), max(v.x) FROM (SELECT CASE k WHEN 0 THEN lo ELSE (lo + hi) / 2 END AS lo, CASE k WHEN 0 THEN (lo + hi) / 2 ELSE hi END AS hi FROM r, s, (VALUES (0), (1)) AS two(k) WHERE n > reach AND a < b) AS h LEFT JOIN v ON v.x >= h.lo AND v.x < h.hi GROUP BY h.lo, h.hi) "
    "SELECT lo, hi, n FROM r, s WHERE n <= reach OR a = b"
)


@query("src_17_adaptive_ranges", _HALVED)
def adaptive_ranges(spark, d):
    """Price ranges that a source which shows a sixteenth of its rows can page through: halved where they hold more, all orders in them."""
    return paged.halved_ranges(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_totalprice").alias("x")), "x", 16)


@query("src_17_quantile_ranges", "SELECT count(*) AS n, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 2 END) AS BIGINT) AS weight, true AS fits FROM orders")
def quantile_ranges(spark, d):
    """Ranges between quantiles that a source which shows a sixteenth of its rows can page through: they hold every order once, none too many."""
    prices = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_totalprice").alias("x"))
    found = paged.adaptive_ranges(prices, "x", F.floor(F.count(F.lit(1)) / 16))
    met = prices.join(F.broadcast(found), F.col("x").between(F.col("lo"), F.col("hi")))  # some dozen ranges; where two overlapped an order would come twice
    return met.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("x") > 100_000, 1).otherwise(2)).alias("weight"), (F.max("n") * 16 <= F.count(F.lit(1))).alias("fits"))


@query("snk_02_csv_export_rows", sql("SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in exports.COLUMNS) + " FROM opportunities"))
def csv_export_rows(spark, d):
    return exports.rows(opportunities(spark, d))


_DAYS = "(deadline - DATE '1998-08-02')"
_DIGEST_ROW = f"concat('<tr><td><a href=\"', opportunity_url, '\">', title, '</a></td><td>', organization, '</td><td>', CASE WHEN deadline IS NULL THEN 'Ongoing' ELSE strftime(deadline, '%d %b %Y') END, '</td><td>', CASE WHEN deadline IS NULL THEN 'Ongoing' WHEN {_DAYS} = 0 THEN 'closes today' WHEN {_DAYS} > 0 THEN concat(CAST({_DAYS} AS VARCHAR), ' days left') ELSE 'closed' END, '</td></tr>')"


@query("snk_14_digest_mail", sql(f"SELECT region, concat('<h2>', region, '</h2><table>', string_agg({_DIGEST_ROW}, '' ORDER BY deadline ASC NULLS LAST, id), '</table>', CASE WHEN max(hidden) > 0 THEN concat('<p>and ', CAST(max(hidden) AS VARCHAR), ' more</p>') ELSE '' END) AS html FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY deadline ASC NULLS LAST, id) AS place, greatest(count(*) OVER (PARTITION BY region) - 10, 0) AS hidden FROM opportunities WHERE status = 'Active') AS x WHERE place <= 10 GROUP BY region"))
def digest_mail(spark, d):
    """A mail section for every region: its ten soonest listings as a table, and how many more there are."""
    return digests.sections(opportunities(spark, d).where("status = 'Active'"), ["region"], "region", 10, AS_OF)
query("src_27_month_first_dates", sql("SELECT id, CASE WHEN deadline < DATE '9999-01-01' THEN deadline END AS deadline FROM opportunities"))(
    lambda spark, d: opportunities(spark, d).select("id", dates.plain_date(F.when(F.col("deadline") < "9999-01-01", F.date_format("deadline", "M/d/yyyy")), dayfirst=False).alias("deadline"))
)
