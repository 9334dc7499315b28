"""Tables of inputs and outputs for the column functions, and the parts of sources that are plain Python."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import amounts, classify, dates, geo, links, organizations, text
from tidewell.operators import filters, routing
from tidewell.sources import paged, records

DAY = datetime.date(2026, 8, 10)


def check(spark, column, table):
    rows = spark.createDataFrame([(i, *(k if isinstance(k, tuple) else (k,))) for i, k in enumerate(table)], "n int, " + ", ".join(f"{c} string" for c in "ab"[: len(next(iter(table))) if isinstance(next(iter(table)), tuple) else 1]))
    assert [r.v for r in rows.select("n", column.alias("v")).orderBy("n").collect()] == list(table.values())


def test_amounts(spark):
    check(spark, amounts.cleaned(F.col("a")), {"£ 5000 read more": "£5000", "varies": "", "n/a": "", "EUR130,000": "EUR 130,000", "other": "", None: "", "US$ 7 for small bodies": "US$7"})
    check(
        spark,
        amounts.extracted(F.col("a")),
        {"Grants ranging from USD 5,000 to USD 10,000 each": "USD 5,000 – USD 10,000", "up to €50,000 per project": "up to €50,000", "The fee is $20": "", "A grant of $2 million": "$2 million", "no money here": "", None: ""},
    )
    check(spark, amounts.in_rupees(F.col("a")), {"USD 10,000": "≈ ₹8.8 L", "£10,000 – £150,000": "≈ ₹11 L – ₹1.7 Cr", "INR 500": "", "plenty": "", "$ 20": "≈ ₹1,750", None: ""})


def test_dates(spark):
    check(spark, dates.plain_date(F.col("a")).cast("string"), {"Apply by: 15 Jul 2026": "2026-07-15", "July 31st, 2026": "2026-07-31", "31/07/2026": "2026-07-31", "Last date - 31.07.2026": "2026-07-31", "soon": None, None: None, "": None})
    rows = spark.createDataFrame([("2026-03-04",), ("31 July 2026",), ("",), ("no date",)], "raw string")
    got = {r.raw: r.deadline for r in dates.with_deadline(rows, "raw", DAY).collect()}
    assert got["2026-03-04"] == datetime.date(2026, 4, 3)  # day first reads ISO dates that way too
    assert got["31 July 2026"] == datetime.date(2026, 7, 31) and got[""] is None
    check(spark, dates.ongoing(F.col("a")), {"Rolling basis": True, "no fixed deadline": True, "31 May": False, None: False})
    assert dates.is_due("weekly", datetime.datetime(2026, 8, 9), datetime.datetime(2026, 8, 10, 9)) and not dates.is_due("manual", None, datetime.datetime(2026, 8, 10))


def test_links(spark):
    check(spark, links.usable(F.col("a"), F.lit("https://x.org/")), {"https://x.org/calls/7": True, "https://x.org": False, "https://x.org/": False, "mailto:a@x.org": False, "/calls/7": False, "https://x.org/view/1,2": False, "": False, None: False, "https://x.org/?id=4": True})
    check(spark, links.kind(F.col("a")), {"https://x.org/a/b": "deep", "https://x.org/grants/": "listing", "https://x.org/a/b?s=rice": "listing", "https://x.org/a": "listing", "": ""})


def test_text(spark):
    check(spark, text.spam(F.col("a"), F.col("b")), {("Call +971 50 123 45 67", ""): True, ("PL2002/000-580.06.02", ""): False, ("Sign in", ""): True, ("Открытый конкурс", ""): True, ("", "casino"): False, ("Review of 123456789012", None): False})
    check(spark, text.shortened(F.col("a"), 12), {"short": "short", "one two three four": "one two…"})
    check(spark, text.html_text(F.col("a")), {"<nav>x</nav><p>a &amp; b</p><script>1<2</script>": "a & b", None: ""})
    check(spark, text.suffix_country(F.col("a")), {"Call for water (Kenya)": "Kenya", "Call ($10,000)": "", "Call": ""})


def test_classifiers(spark):
    check(spark, classify.work_type(F.col("a"), F.col("b")), {("Consultancy services required", ""): "Research", ("Supply of equipment", ""): "Implementation", ("Notice", ""): ""})
    check(spark, classify.study_type(F.col("a"), F.col("b")), {("Baseline and Endline Survey", ""): "Baseline", ("Impact evaluation", ""): "Evaluation", ("Notice", ""): ""})
    check(spark, classify.category(F.col("a"), F.col("b")), {("Request for proposals", ""): "RFP", ("Fellowship", ""): "Other", ("Small grants", ""): "Grant"})


def test_places_and_organizations(spark):
    places = geo.Places({"kenya": "Kenya", "uk": "United Kingdom"}, {"kenya": "Africa", "united kingdom": "Europe"}, {"africa": "Africa", "worldwide": "Global"})
    pair = geo.normalised(F.col("a"), F.col("b"), places)
    check(spark, F.concat_ws("/", pair["country"], pair["region"]), {("UK and Kenya", ""): "United Kingdom/Europe", ("Africa", ""): "/Africa", ("Round 1", ""): "/", ("Lot 2, Kenya", "Worldwide"): "Kenya/Global", ("", "Worldwide"): "/Global"})
    check(
        spark,
        organizations.extracted(F.col("a"), F.lit("")),
        {
            "The Green Trust is inviting applications.": "Green Trust",
            "prose only": "",
            None: "",
            "Deadline: 31-Dec-2026 AI Snippet Summary: The Blue Foundation, that gives grants, is inviting applications": "Blue Foundation",
            "Open call. International Centre for Genetic Engineering and Biotechnology invites proposals.": "International Centre for Genetic Engineering and Biotechnology",
            "The residency is funded by Pro Lucerna and open to all.": "",
            "The residency is funded by Pro Lucerna.": "Pro Lucerna",
            "A scheme funded by the High Peaks Foundation Empowerment Programme.": "High Peaks Foundation",
            "The Small Makers Accelerator is inviting startups.": "",
            "It is offered by Earth Story Network (ESN) in many places.": "Earth Story Network (ESN)",
            "The Rural Arts Trust Bursaries is accepting entries.": "Rural Arts Trust",
            "The Micro Grants by Green Valley Bank provides loans.": "Green Valley Bank",
            "World Food Programme Innovation Challenge seeks ideas.": "World Food Programme Innovation",
            "Grants are provided by the government": "",
        },
    )
    check(spark, organizations.extracted(F.lit(""), F.col("a")), {"Souter Charitable Trust — Funding Opportunity": "Souter Charitable Trust", "Call by the Council": "", "Nothing here": ""})
    check(spark, organizations.tidied(F.col("a"), 40), {"A": "A", ", ".join(["Some Long Name"] * 5): "Some Long Name +4 more"})


def test_search_and_members(spark):
    rows = spark.createDataFrame([(1, "Émile rural water", "", "", "", "", "")], "id long, title string, organization string, summary string, vertical string, country string, eligibility string")
    assert rows.where(filters.search("emi wat")).count() == 1 and rows.where(filters.search("ural")).count() == 0 and rows.where(filters.search('"ural')).count() == 0
    with pytest.raises(ValueError):
        filters.checked_categories(["Nope"])
    pages = spark.createDataFrame([("s", p, 1, int(p == 2)) for p in range(9)], "source string, page int, found int, saved int")
    assert sorted(r.page for r in routing.stale_cut(pages, 3).collect()) == [0, 1, 2, 3, 4, 5]


def test_paging():
    assert paged.page_url("https://x.org/{offset}", 3, 20) == "https://x.org/40" and paged.page_url("https://x.org/?a=1", 2, 20) == "https://x.org/?a=1&page=2"
    waits = []
    answers = iter([(429, ""), (500, ""), (200, "ok")])
    assert paged.fetch_with_retry(lambda _: next(answers), "u", 3, waits.append) == "ok" and waits == [20, 4]
    assert paged.split_range(lambda a, b: b - a, 0, 100, 25) == [(0, 25), (25, 50), (50, 75), (75, 100)]
    assert paged.paging_field(lambda n, p: [p] if n == "pg" else [1], ["page", "pg"]) == "pg" and paged.page_size(lambda n: range(min(n, 200))) == 200
    assert paged.useful_axes(lambda a: {None: 10, "x": 10, "y": 4}[a], ["x", "y"]) == ["y"]
    found = paged.Registry()
    found.register("a", template="t")
    with pytest.raises(ValueError):
        found.register("a")
    with pytest.raises(KeyError):
        found.get(["b"])


def test_records():
    answer = {"meta": [1], "deep": {"rows": [{"id": 1, "fundingTitle": "x"}, {"id": 2}]}, "few": [{"id": 3}]}
    assert len(records.record_list(answer)) == 2 and records.first_value({"countryIds": [1], "countries": [{"name": "Kenya"}, {"name": "Mali"}]}, ["countr"]) == "Kenya, Mali"
    assert records.walk(answer, "deep.rows.0.fundingTitle") == "x" and records.put({"a": {"b": 1}}, "a.c", 2) == {"a": {"b": 1, "c": 2}}
    assert json.loads(json.dumps(records.walk(answer, "nope.1"))) is None


def test_paged_stream(spark, tmp_path):
    for n in range(1, 4):
        (tmp_path / f"{n}.html").write_text(f"page {n}")
    spark.dataSource.register(paged.PagedSource)
    options = {"template": "https://x.org/?page={page}", "pages": "9", "pages_per_partition": "2", "folder": str(tmp_path)}
    assert sorted(r.page for r in spark.read.format("paged").options(**options).load().collect()) == [1, 2, 3]


def test_places_are_never_cut(spark):
    from tidewell.functions import geo

    rows = spark.range(10_001).selectExpr("concat('Land ', id) AS country", "'Region' AS region")
    with pytest.raises(ValueError, match="more than 10000 pairs"):
        geo.places_of(rows)
    assert len(geo.places_of(rows.where("id < 10000")).country) == 10_000


def test_members_meet_listings_on_equal_keys_as_by_looping(spark, sf_dir, monkeypatch):
    from tidewell import fixtures
    from tidewell.config import AS_OF
    from tidewell.operators import routing

    rows = [(10 + i, "x", "x@example.org", True, True, kw, cats, verts) for i, (kw, cats, verts) in enumerate([("steel, ring", "", ""), ("ri", "", ""), ("", "", "edu"), ("", "Grant, RFP", ""), ("bolt", "Nonsense", "Health, Gender"), ("", "", ""), ("usd", "Tender", "climate"), (",,", "", "he"), ("grants up", "", "")])]
    people = fixtures.members(spark).union(spark.createDataFrame(rows, fixtures.MEMBER_COLUMNS))
    opps, found = fixtures.opportunities(spark, sf_dir), []
    for limit in (1000, 0):
        monkeypatch.setattr(routing, "MEMBER_LIMIT", limit)
        met = routing.matches(opps, people, AS_OF)
        found.append(sorted((r.member_id, r.id) for r in met.select("member_id", "id").collect()))
        assert "_key" not in met.columns
    assert found[0] == found[1] and len({m for m, _ in found[0]}) > 8


def test_tokens_are_signed_as_the_standard_says(spark):
    import base64
    import hashlib
    import hmac

    from pyspark.sql import functions as F
    from tidewell.functions import tokens

    for key in ("k", "a key that is longer than one block " * 3):
        row = spark.createDataFrame([('{"id":1,"exp":100}',), ('{"by":"é"}',)], "p string").select("p", tokens.minted(F.col("p"), key).alias("t"))
        for r in row.select("p", "t", tokens.payload_of(F.col("t"), key, 99).alias("now"), tokens.payload_of(F.col("t"), key, 100).alias("late"), tokens.payload_of(F.col("t"), "other", 1).alias("forged"), tokens.payload_of(F.lit("x.y"), key, 1).alias("bad")).collect():
            body, code = r.t.split(".")
            assert base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)).decode() == r.p == r.now and r.forged is None and r.bad is None
            assert code == base64.urlsafe_b64encode(hmac.new(key.encode(), body.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()
            assert r.late == (None if "exp" in r.p else r.p)


def test_places_of_the_world():
    from tidewell.functions.places import WORLD

    assert WORLD.country["uk"] == "United Kingdom" and WORLD.region["kenya"] == "Africa" and WORLD.scope["worldwide"] == "Global"
    assert all(name.lower() in WORLD.region for name in WORLD.country.values())


def test_a_cluster_has_to_name_its_shared_folder(spark):
    from tidewell import shared

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    Context.master = "local[4]"
    assert shared.shared_dir(Session()).startswith("/tmp/")
