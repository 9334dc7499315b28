"""Scalar functions over text, dates, amounts, places, links and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF, ENABLED_CATEGORIES
from ..fixtures import opportunities, sql
from ..functions import amounts, classify, dates, geo, links, organizations, text, tokens
from ..operators import digests
from ..operators import filters as flt
from ..functions.lexicons import CATEGORY_PATTERNS, IMPLEMENTATION_PATTERNS, RESEARCH_PATTERNS
from ..functions.places import WORLD
from ..registry import query

_SHA = "sha256(concat(lower(trim(title)), '|', lower(trim(organization)), '|', coalesce(strftime(deadline, '%Y-%m-%d'), ''), '|', lower(trim(opportunity_url))))"


def _column(name: str, column, oracle: str | None = None, alias: str = "value"):
    query(name, sql(f"SELECT id, {oracle} AS {alias} FROM opportunities") if oracle else None)(lambda spark, d: opportunities(spark, d).select("id", column().alias(alias)))


def _cases(name: str, cases: list[tuple[str, str]], column):
    """A function over every listing: texts with {id}, {n} (id % 1000 + 1) and {name} in turn, and what comes of them."""
    n = len(cases)

    def filled(text):
        parts = F.replace(F.replace(F.lit(text), F.lit("{id}"), F.col("id").cast("string")), F.lit("{n}"), (F.col("id") % 1000 + 1).cast("string"))
        return F.replace(parts, F.lit("{name}"), F.initcap(F.substring_index("title", " ", 1)))

    raw = lambda: F.coalesce(*(F.when(F.col("id") % n == i, filled(text)) for i, (text, _) in enumerate(cases)))
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    word = "concat(upper(substring(title, 1, 1)), lower(substring(split_part(title, ' ', 1), 2)))"
    told = " ".join(f"WHEN {i} THEN replace(replace(replace({quoted(want)}, '{{id}}', CAST(id AS VARCHAR)), '{{n}}', CAST(id % 1000 + 1 AS VARCHAR)), '{{name}}', {word})" for i, (_, want) in enumerate(cases))
    query(name, sql(f"SELECT id, CASE id % {n} {told} END AS value FROM opportunities"))(lambda spark, d: opportunities(spark, d).select("id", column(raw()).alias("value")))


def _points(patterns: list[str], title: str = "title", body: str = "summary") -> str:
    """The score of a pattern list in SQL."""
    found = [(field, points, p.replace("'", "''")) for p in patterns for field, points in ((title, 3), (body, 1))]
    return " + ".join(f"CASE WHEN regexp_matches({field}, '(?i){p}') THEN {points} ELSE 0 END" for field, points, p in found)


def _labels_sql(lexicon: dict[str, list[str]], body: str = "summary") -> str:
    """All labels that score two, joined."""
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {_points(ps, body=body)} >= 2 THEN '{label}' END" for label, ps in lexicon.items()) + ")"


_R, _I = (f"({_points(p)})" for p in (RESEARCH_PATTERNS, IMPLEMENTATION_PATTERNS))
_WORK = f"(SELECT CASE WHEN greatest(r, i) < 3 OR abs(r - i) < 2 THEN '' WHEN r > i THEN 'Research' ELSE 'Implementation' END FROM (SELECT {_R} AS r, {_I} AS i) AS s)"
_FULL = {k: p for k, p in CATEGORY_PATTERNS.items() if k in ENABLED_CATEGORIES}
_FULL_HITS = {k: f"({_points(p)} + CASE WHEN category = '{k}' THEN 2 ELSE 0 END)" for k, p in _FULL.items()}
_FULL_BEST = f"greatest({', '.join(_FULL_HITS.values())})"


_column("txt_01_normal_form", lambda: text.normal(F.concat(F.lit("  A  "), F.col("title"))), "concat('a ', lower(title))")
_column("txt_02_unique_id", lambda: text.unique_id(F.col("title"), F.col("organization"), F.col("deadline"), F.col("opportunity_url")), _SHA)
_LEX = {"RFP": [r"request\s+for\s+proposals?"], "Tender": [r"\btenders?\b"], "Grant": [r"\bgrants?\b"], "Proposal": [r"call\s+for\s+proposals?"]}
_HITS = {k: f"(CASE WHEN regexp_matches(title, '(?i){p[0]}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(summary, '(?i){p[0]}') THEN 1 ELSE 0 END + CASE WHEN category = '{k}' THEN 2 ELSE 0 END)" for k, p in _LEX.items()}
_BEST = f"greatest({', '.join(_HITS.values())})"
_column("txt_03_category", lambda: classify.category(F.col("title"), F.col("summary"), F.col("category"), _LEX), "CASE WHEN " + _BEST + " = 0 THEN 'Other' " + " ".join(f"WHEN {h} = {_BEST} THEN '{k}'" for k, h in _HITS.items()) + " END")
_column("txt_03_category_full_lexicon", lambda: classify.category(F.col("title"), F.col("summary"), F.col("category")), "CASE WHEN " + _FULL_BEST + " = 0 THEN 'Other' " + " ".join(f"WHEN {h} = {_FULL_BEST} THEN '{k}'" for k, h in _FULL_HITS.items()) + " END")
_V = {"Rings": ["ring", "bolt"], "Tools": ["widget"], "Money": [r"\bgrants?\b"]}
_VSCORE = {k: " + ".join(f"CASE WHEN regexp_matches(title, '(?i){p}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(summary, '(?i){p}') THEN 1 ELSE 0 END" for p in ps) for k, ps in _V.items()}
_column("txt_04_verticals", lambda: text.joined(classify.verticals(F.col("title"), F.col("summary"), _V)), "concat_ws(', ', " + ", ".join(f"CASE WHEN {s} >= 2 THEN '{k}' END" for k, s in _VSCORE.items()) + ")")
_SUBJECTS = [("Solar irrigation for smallholder farmers", "Livelihood, Climate/Sustainability(ESG)"), ("{name} Charitable Trust", ""), ("Maternal health clinics in rural areas", "Livelihood, Health"), ("Occupational safety of garment workers", "Worker Wellbeing"), ("Blended finance for startups", "Innovative Finance"), ("Baseline study number {id}", "E4C(Evidence for Change)")]
_cases("txt_04_verticals_of_the_world", _SUBJECTS, lambda c: text.joined(classify.verticals(c, F.lit(""))))
_column("txt_05_team_terms", lambda: F.size(F.filter(F.array(*(F.col("title").rlike(f"(?i){p}") for p in classify.term_patterns(["steel ring", "blue  widget", "abc"]))), lambda x: x)), "CASE WHEN regexp_matches(title, '(?i)\\bsteel\\s+ring\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(title, '(?i)\\bblue\\s+widget\\b') THEN 1 ELSE 0 END")
_column("txt_06_work_type", lambda: classify.work_type(F.col("title"), F.col("summary")), _WORK)
_column("txt_07_study_type", lambda: classify.study_type(F.col("title"), F.col("summary")), "CASE id % 9 WHEN 0 THEN 'Baseline' WHEN 4 THEN 'Evaluation' ELSE 'Data Collection' END")
_column("txt_08_labels_round_trip", lambda: text.joined(flt.labels()), "verticals")
_column("txt_09_csv", lambda: F.size(text.csv(F.concat("verticals", F.lit(", , x")))), "CASE WHEN verticals = '' THEN 1 ELSE length(verticals) - length(replace(verticals, ',', '')) + 2 END")
_column("txt_10_body", lambda: text.body(F.col("summary"), F.col("eligibility"), F.col("vertical")), "concat_ws(' ', nullif(summary, ''), nullif(eligibility, ''), nullif(vertical, ''))")
_column("txt_11_clean_amount", lambda: amounts.cleaned(F.concat("funding_amount", F.lit(" read more here"))), "CASE WHEN funding_amount = '' THEN '' ELSE funding_amount END")
_column("txt_12_extract_amount", lambda: amounts.extracted(F.col("summary")), "concat('up to ', regexp_extract(summary, 'USD [0-9]+'))")
_cases("txt_13_tidy_number", [("£ {id}", "£{id}"), ("EUR{id},000", "EUR {id},000"), (" $  {n} . ", "${n}"), ("US$ {id}", "US${id}")], amounts.tidy)


def _places(spark, d):
    return geo.places_of(opportunities(spark, d).select("country", "region").distinct(), {"n3": "NATION_3"}, {"worldwide": "Global"})


@query("txt_14_canonical_country", sql("SELECT id, CASE id % 4 WHEN 0 THEN country WHEN 1 THEN '' WHEN 2 THEN 'NATION_3' ELSE '' END AS value FROM opportunities"))
def canonical_country(spark, d):
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit("("), F.col("country"), F.lit(").")))
    raw = raw.when(F.col("id") % 4 == 1, F.lit("Round 1")).when(F.col("id") % 4 == 2, F.lit("N3")).otherwise("Lot 4")
    return opportunities(spark, d).select("id", geo.canonical_country(raw, _places(spark, d)).alias("value"))


@query("txt_15_normalize_geo", sql("SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE country END AS country, CASE WHEN id % 3 = 2 THEN 'Global' ELSE region END AS region FROM opportunities"))
def normalize_geo(spark, d):
    raw = F.when(F.col("id") % 3 == 0, F.col("region")).when(F.col("id") % 3 == 1, F.concat(F.lit("Worldwide, Lot 4 and "), F.col("country"), F.lit("; NATION_1"))).otherwise(F.col("country"))
    given = F.when(F.col("id") % 3 == 2, "worldwide").otherwise("")
    return opportunities(spark, d).select("id", geo.normalised(raw, given, _places(spark, d)).alias("g")).select("id", "g.country", "g.region")


_COUNTRIES = [("UK", "United Kingdom"), ("(Kenya).", "Kenya"), ("Round 1", ""), ("$10", ""), ("2025-26", ""), ("Trinidad and Tobago", "Trinidad and Tobago"), ("cote d'ivoire", "Côte d’Ivoire"), ("{name}land", ""), ("viet nam", "Vietnam")]
_cases("txt_14_canonical_country_of_the_world", _COUNTRIES, lambda c: geo.canonical_country(c, WORLD))
_PAIRS = [("Africa", "|Africa"), ("UK", "United Kingdom|Europe"), ("UK and India", "United Kingdom|Europe"), ("Trinidad and Tobago", "Trinidad and Tobago|Latin America"), ("EU 27, India", "India|South Asia"), ("Round 1", "|"), ("Worldwide", "|Global"), ("{name}land; Kenya", "Kenya|Africa")]
_cases("txt_15_normalize_geo_of_the_world", _PAIRS, lambda c: F.concat_ws("|", geo.normalised(c, F.lit(""), WORLD)["country"], geo.normalised(c, F.lit(""), WORLD)["region"]))


@query("jon_13_geo_lookup", sql("SELECT id, country, r_name AS region, r_regionkey AS region_key FROM opportunities LEFT JOIN (SELECT upper(n_name) AS key, r_name, r_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey) AS places ON key = upper(trim(country))"))
def geo_lookup(spark, d):
    """Every listing's region by a join with the table of countries."""
    nation, region = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("nation", "region"))
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("r_regionkey").alias("region_key"))
    return geo.looked_up(opportunities(spark, d).select("id", "country"), places)


_cases("txt_16_display_case", [("bosnia and herzegovina", "Bosnia and Herzegovina"), ("u.s. virgin islands", "U.S. Virgin Islands"), ("guinea-bissau {id}", "Guinea-Bissau {id}"), ("ISLE OF MAN", "Isle of Man")], geo.display_case)
_ORGANIZATIONS = [("The {name} Trust is inviting applications.", "{name} Trust"), ("A scheme funded by the {name} Journalism Network (EJN) in Asia.", "{name} Journalism Network (EJN)"), ("Some prose number {id} without a name.", ""), ("Grant The {name} Foundation is inviting proposals.", "{name} Foundation"), ("The {name} Foundation, that provides grants to many, is inviting proposals.", "{name} Foundation"), ("Deadline: 31-Dec-2026 AI Snippet Summary: The {name} Council, which is new, announces a call.", "{name} Council"), ("The programme by the {name} Institute provides support.", "{name} Institute")]
_cases("txt_17_extract_organization", _ORGANIZATIONS, lambda c: organizations.extracted(c, F.lit("")))
_column("txt_18_tidy_organization", lambda: organizations.tidied(F.concat_ws(", ", F.array_repeat(F.rpad("organization", 18, "x"), 20))), "concat(rtrim(repeat(concat(rpad(organization, 18, 'x'), ', '), 9), ', '), ' +11 more')")
_column("txt_19_furniture", lambda: text.furniture(F.when(F.col("id") % 5 == 0, F.lit(" Read  More:")).otherwise(F.col("title"))), "id % 5 = 0")
_column("txt_20_spam", lambda: text.spam(F.when(F.col("id") % 5 == 0, F.lit("Best offer +971 50 123 45 67")).when(F.col("id") % 5 == 1, F.lit("Открытый конкурс на лучшую работу")).when(F.col("id") % 5 == 2, F.lit("Ref 123456789012 review")).otherwise(F.col("title")), F.col("summary")), "id % 5 IN (0, 1)")
_column("flt_18_spam_reject", lambda: ~text.spam(F.when(F.col("id") % 7 == 0, F.concat(F.lit("Call +44 20 7946 0958 "), "title")).when(F.col("id") % 7 == 1, F.lit("Skip to main content")).otherwise(F.col("title")), F.when(F.col("id") % 7 == 2, F.lit("buy cytotec pills")).otherwise(F.col("summary"))), "id % 7 > 2")
_column("flt_19_junk_report", lambda: text.junk_title(F.when(F.col("id") % 6 == 0, F.lit("a@b.org")).when(F.col("id") % 6 == 1, F.lit("short")).otherwise(F.col("title"))), "id % 6 IN (0, 1)")
_column("flt_20_numeric_organization", lambda: F.when(text.numeric_only(F.when(F.col("id") % 2 == 0, F.lit("118,391 7")).otherwise(F.col("organization"))), "").otherwise(F.col("organization")), "CASE WHEN id % 2 = 0 THEN '' ELSE organization END")
_column("txt_21_usable_link", lambda: links.usable(F.col("opportunity_url"), F.col("website")), "opportunity_url <> '' AND NOT opportunity_url LIKE '%/view/12,13'")
_column("txt_22_link_kind", lambda: links.kind(F.col("opportunity_url")), "CASE WHEN opportunity_url = '' THEN '' WHEN opportunity_url LIKE '%/grants/' THEN 'listing' ELSE 'deep' END")
_cases("txt_23_canonical_link", [("https://www.unpartnerportal.org/api/public/export/projects/{id}/", "https://www.unpartnerportal.org/landing/opportunities/{id}/"), ("https://example.org/x{id}", "https://example.org/x{id}")], links.canonical)
_column("txt_24_search_link", lambda: links.search(F.col("title"), F.col("website"), F.col("source_website")), "concat('https://duckduckgo.com/?q=site%3A', replace(website, 'https://', ''), '+', replace(title, ' ', '+'))")
_column("txt_25_root_check", lambda: links.is_root(F.when(F.col("id") % 2 == 0, F.col("website")).otherwise(F.concat("website", F.lit("/?a=1")))), "id % 2 = 0")
_column("txt_26_resolved_link", lambda: links.resolved(F.col("opportunity_url"), F.col("website"), F.col("source_website"), F.col("title"))["kind"], "CASE WHEN opportunity_url <> '' AND NOT opportunity_url LIKE '%/view/12,13' THEN 'direct' ELSE 'search' END")
_column("txt_27_label_by_hint", lambda: classify.vertical_by_hint(F.col("title"), [("R", ["ring"]), ("B", ["bolt", "nut"])]), "CASE WHEN contains(lower(title), 'ring') THEN 'R' WHEN contains(lower(title), 'bolt') OR contains(lower(title), 'nut') THEN 'B' ELSE '' END")
_cases("txt_28_display_name", [("ada.lovelace{id}@example.org", "Ada Lovelace{id}"), ("b_c-d@x{id}.org", "B C D"), ("{name}@example.org", "{name}")], text.display_name)
_column("txt_29_shortened", lambda: text.shortened(F.col("summary"), 40), "CASE WHEN length(summary) <= 40 THEN summary ELSE concat(regexp_replace(substring(summary, 1, 39), '\\s+\\S*$', ''), '…') END")
_column("txt_30_listing_title", lambda: text.listing_title(F.col("title")), "length(title) BETWEEN 18 AND 300")
_cases("txt_31_suffix_country", [("Call number {id} (Kenya)", "Kenya"), ("Call {id} (Round x)", ""), ("Call {id} (2026)", ""), ("Call {id} (Costa Rica) ", "Costa Rica"), ("Call {id} (USD 5)", ""), ("Call {id}", "")], text.suffix_country)
_cases("txt_32_in_rupees", [("USD 10,000", "≈ ₹8.8 L"), ("£10,000 – £150,000", "≈ ₹11 L – ₹1.7 Cr"), ("EUR 1.5 million", "≈ ₹14 Cr"), ("INR {id}", ""), ("no money {id}", ""), ("$ 20k", "≈ ₹18 L")], amounts.in_rupees)
_DAYS_LEFT = "(deadline - DATE '1998-08-02')"
_column("txt_35_digest_row", lambda: digests.row(AS_OF), f"concat('<tr><td><a href=\"', opportunity_url, '\">', title, '</a></td><td>', organization, '</td><td>', CASE WHEN deadline IS NULL THEN 'Ongoing' ELSE strftime(deadline, '%d %b %Y') END, '</td><td>', CASE WHEN deadline IS NULL THEN 'Ongoing' WHEN {_DAYS_LEFT} = 0 THEN 'closes today' WHEN {_DAYS_LEFT} > 0 THEN concat(CAST({_DAYS_LEFT} AS VARCHAR), ' days left') ELSE 'closed' END, '</td></tr>')")
_KEY, _NOW = "a key for the fixture only", 900_000_000
_INNER, _OUTER = (p.hex() for p in tokens._pads(_KEY))
_B64 = "rtrim(replace(replace(to_base64({}), '+', '-'), '/', '_'), '=')"
_JSON = "concat('{\"id\":', id, ',\"by\":\"', source_website, '\",\"exp\":', 899999990 + id % 40, '}')"
_CODED = _B64.format(f"encode({_JSON})")
_SIGNED = _B64.format(f"unhex(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({_CODED})))))")


@query("txt_33_signed_tokens", sql(f"SELECT id, concat({_CODED}, '.', {_SIGNED}) AS token, CASE WHEN id % 3 > 0 AND id % 40 > 10 THEN {_JSON} END AS payload FROM opportunities"))
def signed_tokens(spark, d):
    """A token for every listing, and what is read from it: nothing where it was tampered with or has ended."""
    payload = F.to_json(F.struct("id", F.col("source_website").alias("by"), (899_999_990 + F.col("id") % 40).alias("exp")))
    rows = opportunities(spark, d).select("id", tokens.minted(payload, _KEY).alias("token"))
    shown = F.when(F.col("id") % 3 == 0, F.concat(F.lit("e30"), "token")).otherwise(F.col("token"))
    return rows.select("id", "token", tokens.payload_of(shown, _KEY, _NOW).alias("payload"))


_BARE = "html"
for _t in ("script", "style", "nav", "header", "footer"):
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_t}\\b.*?</{_t}\\s*>', ' ', 'g')"
_BARE = f"regexp_replace(regexp_replace({_BARE}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#8217;", "’"), ("&#8211;", "–"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_a}', '{_b}')"
query("txt_34_html_text", f"SELECT page_id, substring(trim(regexp_replace({_BARE}, '\\s+', ' ', 'g')), 1, 20000) AS value FROM pages")(lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.html_text(F.col("html")).alias("value")))

def _shown():
    """A listing's deadline as sources write it, in six ways."""
    ways = ["d MMMM yyyy", "'Apply by: 'd MMM yyyy", "MMMM d'th', yyyy", "d/M/yyyy", "'Last date - 'd.M.yyyy", "'sometime'"]
    return F.coalesce(*(F.when(F.col("id") % 6 == i, F.date_format("deadline", w)) for i, w in enumerate(ways)))


_column("dat_01_parse_plain", lambda: dates.plain_date(_shown()), "CASE WHEN id % 6 < 5 AND deadline < DATE '9999-01-01' THEN deadline WHEN id % 6 < 5 THEN deadline END")


@query("dat_01_parse_fuzzy", sql("SELECT id, CASE WHEN id % 4 < 2 AND deadline < DATE '9999-01-01' THEN deadline END AS deadline FROM opportunities"))
def parse_fuzzy(spark, d):
    """Dates in the middle of a sentence, and sentences without one."""
    raw = F.when(F.col("id") % 4 == 0, F.date_format("deadline", "'closes on 'd' of 'MMMM, yyyy' at noon'")).when(F.col("id") % 4 == 1, F.date_format("deadline", "'Proposals are due by 'MMMM d, yyyy"))
    raw = raw.when(F.col("id") % 4 == 2, F.lit("")).otherwise(F.lit("rolling"))
    rows = opportunities(spark, d).select("id", F.when(F.col("deadline") < "9999-01-01", raw).otherwise(F.lit("to be announced")).alias("raw"))
    return dates.with_deadline(rows, "raw", AS_OF).select("id", "deadline")


@query("dat_01_parse_column", sql("SELECT id, CASE WHEN deadline < DATE '9999-01-01' THEN deadline END AS deadline FROM opportunities"))
def parse_column(spark, d):
    known = F.when(F.col("deadline") < "9999-01-01", F.col("deadline"))
    rows = opportunities(spark, d).withColumn("deadline", known).select("id", F.concat(F.lit("Deadline: "), F.date_format("deadline", "d MMMM yyyy")).alias("raw"))
    return dates.with_deadline(rows, "raw", AS_OF).select("id", "deadline")


_column("dat_02_ongoing", lambda: dates.ongoing(F.when(F.col("id") % 4 == 0, F.lit("open-ended call")).otherwise(F.col("title"))), "id % 4 = 0")
_column("dat_03_is_active", lambda: dates.is_active(F.col("deadline"), AS_OF), "coalesce(deadline >= DATE '1998-08-02', false)")
_column("dat_04_sentinel", lambda: dates.sentinel(F.col("deadline"), AS_OF), "coalesce(deadline > DATE '2001-08-01', false)")
_column("dat_05_status", lambda: dates.status(F.col("deadline"), F.col("id") % 20 == 0, AS_OF), "CASE WHEN deadline >= DATE '1998-08-02' OR (deadline IS NULL AND id % 20 = 0) THEN 'Active' ELSE 'Expired' END")
_AUDIT = "CASE WHEN deadline > DATE '2001-08-01' THEN NULL ELSE deadline END"


@query("dat_06_deadline_audit", sql(f"SELECT id, {_AUDIT} AS deadline, CASE WHEN ({_AUDIT}) IS NULL THEN status WHEN deadline < DATE '1998-08-02' THEN 'Expired' ELSE 'Active' END AS status FROM opportunities"))
def deadline_audit(spark, d):
    return dates.audited(opportunities(spark, d), AS_OF).select("id", "deadline", "status")


_LEFT = "(deadline - DATE '1998-08-02')"
_column("dat_07_urgency", lambda: dates.urgency(F.col("deadline"), AS_OF), f"CASE WHEN deadline IS NULL THEN 'none' WHEN {_LEFT} <= 3 THEN 'red' WHEN {_LEFT} <= 7 THEN 'orange' WHEN {_LEFT} <= 14 THEN 'amber' ELSE 'grey' END")
_column("dat_08_days_left", lambda: dates.days_left(F.col("deadline"), AS_OF).cast("long"), f"CASE WHEN deadline IS NULL THEN 0 ELSE greatest(0, {_LEFT}) END")
_column("dat_09_reminder_date", lambda: dates.reminder_date(AS_OF, (F.col("id") % 90 + 1).cast("int")), "DATE '1998-08-02' + CAST(id % 90 + 1 AS INTEGER)")
_column("dat_10_block_deadline", lambda: F.regexp_extract(F.concat("summary", F.lit(" Closing date: "), F.coalesce(F.date_format("deadline", "d MMMM yyyy"), F.lit("none")), F.lit(".")), dates.DATE_SHAPES, 0), "coalesce(strftime(deadline, '%-d %B %Y'), '')")
_column("dat_11_format", lambda: F.date_format("deadline", "dd MMM yyyy"), "strftime(deadline, '%d %b %Y')")
_column("dat_12_duration", lambda: dates.duration(F.col("id").cast("double")), "CASE WHEN id < 60 THEN concat(CAST(id AS VARCHAR), 's') ELSE concat(CAST(id // 60 AS VARCHAR), 'm ', CAST(id % 60 AS VARCHAR), 's') END")
_column("dat_14_reminder_days", lambda: F.array_join(dates.reminder_days(F.array((F.col("id") % 95).cast("int"), F.lit(7), F.lit(7), F.lit(200)), (10, 7, 2)), ","), "CASE WHEN id % 95 BETWEEN 8 AND 90 THEN concat(CAST(id % 95 AS VARCHAR), ',7') WHEN id % 95 BETWEEN 1 AND 6 THEN concat('7,', CAST(id % 95 AS VARCHAR)) ELSE '7' END")

_column("win_07_argmax_label", lambda: classify.category(F.col("title"), F.lit(""), None, _LEX), "CASE WHEN regexp_matches(title, '(?i)request\\s+for\\s+proposals?') THEN 'RFP' WHEN regexp_matches(title, '(?i)\\btenders?\\b') THEN 'Tender' WHEN regexp_matches(title, '(?i)\\bgrants?\\b') THEN 'Grant' WHEN regexp_matches(title, '(?i)call\\s+for\\s+proposals?') THEN 'Proposal' ELSE 'Other' END")
_cases("win_08_argmax_specific", [("Baseline and Endline Evaluation {id}", "Baseline"), ("Evaluation of {name}", "Evaluation"), ("{name} number {id}", ""), ("Endline study", "Endline")], lambda c: classify.study_type(c, F.lit("")))
