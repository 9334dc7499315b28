"""Listings out of saved HTML, in column expressions where a pattern is enough, else by the standard parser in batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, links, organizations, text

LISTINGS = "page_id long, title string, url string, context string"
CARDS = "page_id long, fields map<string,string>"


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, place, href, label) of all anchors, in generated code."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("place", "tag"))
    label = text.squeezed(text.unescaped(F.regexp_replace("tag", r"(?s)<[^>]*>", " ")))
    return rows.select("page_id", "place", "url", F.regexp_extract("tag", r"(?is)href=[\"']([^\"']+)[\"']", 1).alias("href"), label.alias("label"))


def absolute(base: Column, href: Column) -> Column:
    root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/")
    return F.when(href.rlike(r"^[a-z]+://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


BLOCK = r"(?is)<(?:article|li|tr|div)\b[^>]*>((?:(?!<(?:article|li|tr|div)\b).)*?<a\s[^>]*href=[\"'][^\"']+[\"'].*?)</(?:article|li|tr|div)\s*>"
DEADLINE = r"(?i)\b(?:deadline|closing date|closes(?: on)?|apply by|due(?: date)?|last date)\s*[:\-–]?\s*(\d{1,2}[\s./-]\w{3,9}[\s./-]+\d{2,4}|\w{3,9}\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4})"


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, place, title, url, deadline_raw, summary, assume_active) of the innermost blocks that hold a link.

    The title is the link's text, or the block's heading where the link says nothing; the deadline
    and the summary come from the block's text. A listing without a deadline counts as open.
    """
    strip = lambda x: text.squeezed(text.unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", " ")))
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>", " ")
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(bare, F.lit(BLOCK), F.lit(1))).alias("place", "block"))
    href = F.regexp_extract("block", r"(?is)<a\s[^>]*href=[\"']([^\"']+)[\"']", 1)
    label, heading = strip(F.regexp_extract("block", r"(?is)<a\s[^>]*>(.*?)</a>", 1)), strip(F.regexp_extract("block", r"(?is)<h[1-5][^>]*>(.*?)</h[1-5]>", 1))
    rows = found.select("page_id", "place", absolute(F.col("url"), href).alias("link"), F.when(text.listing_title(label), label).when(text.listing_title(heading), heading).alias("title"), F.substring(strip(F.col("block")), 1, 1200).alias("block"))
    deadline = F.regexp_extract("block", DEADLINE, 1)
    summary = F.when(F.length("block") > F.length("title") + 40, F.substring("block", 1, 1000)).otherwise("")
    first = rows.where("title IS NOT NULL").groupBy("page_id", "link").agg(F.min_by(F.struct("place", "title", "block"), "place").alias("x")).select("page_id", "link", "x.*")
    return first.select("page_id", "place", text.cleaned_title(F.col("title")).alias("title"), F.col("link").alias("url"), deadline.alias("deadline_raw"), summary.alias("summary"), (deadline == "").alias("assume_active"))


def next_page(pages: DataFrame, template: str | None = None, page_size: int = 10) -> DataFrame:
    """(page_id, next) of pages (page_id, url, html, page, found): the source's own template, rel=next, the link with the next number, an arrow, or the URL's own number.

    A template, and the number in the URL, only lead on from a page that had items.
    """
    n = (F.col("page") + 1).cast("string")
    anchor = r"(?is)<a\b[^>]*href=[\"']([^\"'#][^\"']*)[\"'][^>]*>\s*(?:{})\s*</a>"
    rel = F.regexp_extract("html", r"(?is)<(?:a|link)\b(?=[^>]*\brel=[\"']next[\"'])[^>]*href=[\"']([^\"'#][^\"']*)[\"']", 1)
    links_ = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*href=[\"'][^\"'#][^\"']*[\"'][^>]*>\s*\d+\s*</a>)"), F.lit(1)), lambda a: F.struct(F.regexp_extract(a, r"href=[\"']([^\"']*)", 1).alias("href"), F.trim(F.regexp_replace(a, r"(?s)<[^>]*>", "")).alias("label"), a.alias("tag")))
    numbered = F.filter(links_, lambda x: (x["label"] == n) & (F.lower(x["tag"]).rlike(r"class=[\"'][^\"']*pag") | x["href"].rlike(r"(?i)([?&](?:page|p|pg|paged|pagenumber)=|/page/)\d+")))
    number = F.when(F.size(numbered) > 0, F.get(numbered, F.lit(0))["href"])
    arrow = F.regexp_extract("html", anchor.format(r"next|next page|next »|»|›|>|&raquo;|&gt;|older|older posts|load more|show more|view more"), 1)
    own = r"(?i)((?:[?&](?:page|p|pg|paged|pagenumber)=|/page/))(\d+)"
    bumped = F.when(F.col("url").rlike(own) & (F.col("found") > 0), F.regexp_replace("url", F.lit(own), F.concat(F.lit("$1"), n)))
    href = F.coalesce(F.nullif(rel, F.lit("")), number, F.nullif(arrow, F.lit("")))
    guessed = F.when(href.isNotNull(), absolute(F.col("url"), href)).otherwise(bumped)
    if template:
        made = F.replace(F.replace(F.lit(template), F.lit("{page}"), n), F.lit("{offset}"), (F.col("page") * page_size).cast("string"))
        guessed = F.when((F.col("found") > 0) & (made != F.col("url")), made)
    return pages.select("page_id", guessed.alias("next"))


def form_request(pages: DataFrame) -> DataFrame:
    """(page_id, body) of pages (page_id, html, page): what is posted to come to the next page, by the form's hidden fields and the target of the link to that number; null where there is none."""
    return pages.select("page_id", form_body(F.col("html"), F.col("page")).alias("body"))


def form_body(html: Column, page: Column) -> Column:
    """What a page's form posts to come to the next number; null where there is no link to that, or no page."""
    hidden = F.regexp_extract_all(html, F.lit(r"(?is)(<input\b(?=[^>]*\btype=[\"']hidden[\"'])[^>]*>)"), F.lit(1))
    part = lambda tag, name: text.unescaped(F.regexp_extract(tag, rf"(?is)\b{name}=[\"']([^\"']*)[\"']", 1))
    fields = F.transform(F.filter(hidden, lambda tag: part(tag, "name") != ""), lambda tag: F.concat(F.url_encode(part(tag, "name")), F.lit("="), F.url_encode(part(tag, "value"))))
    link = r"(?is)__doPostBack\(\s*'([^']*)'\s*,\s*'([^']*)'\s*\)[^>]*>\s*(\d+)\s*<"
    targets, arguments, numbers = (F.regexp_extract_all(html, F.lit(link), F.lit(i)) for i in (1, 2, 3))
    at = F.array_position(numbers, (page + 1).cast("string")).cast("int")
    told = F.array(F.concat(F.lit("__EVENTTARGET="), F.url_encode(F.get(targets, at - 1))), F.concat(F.lit("__EVENTARGUMENT="), F.url_encode(F.get(arguments, at - 1))))
    return F.when(at > 0, F.array_join(F.concat(fields, told), "&"))


def listings(pages: DataFrame, same_site: bool = True) -> DataFrame:
    """Anchors that look like listings: a fitting title, on the same site, each URL once a page."""
    found = anchors(pages).where(~F.lower("href").rlike(r"^(mailto:|javascript:|tel:|#|data:)")).withColumn("link", absolute(F.col("url"), F.col("href")))
    found = found.where(text.listing_title(F.col("label")))
    if same_site:
        found = found.where(links.host(F.col("link")) == links.host(F.col("url")))
    first = found.groupBy("page_id", "link").agg(F.min_by("label", "place").alias("title"), F.min("place").alias("place"))
    return first.select("page_id", "place", text.cleaned_title(F.col("title")).alias("title"), F.col("link").alias("url"))


def next_link(pages: DataFrame) -> DataFrame:
    """(page_id, next): the rel=next link, else one labelled next."""
    rel = F.regexp_extract("html", r"(?is)<(?:a|link)\b(?=[^>]*\brel=[\"']next[\"'])[^>]*href=[\"']([^\"']+)[\"']", 1)
    word = F.regexp_extract("html", r"(?is)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>\s*(?:next|»|›|&raquo;|&gt;)\s*</a>", 1)
    href = F.when(rel != "", rel).otherwise(word)
    return pages.select("page_id", F.when(href != "", absolute(F.col("url"), href)).alias("next"))


def page_numbers(pages: DataFrame, current: Column) -> DataFrame:
    """(page_id, next_page): the smallest page number on a page link beyond the current one."""
    numbers = F.transform(F.regexp_extract_all("html", F.lit(r"[?&]page=(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return pages.select("page_id", F.array_min(F.filter(numbers, lambda n: n > current)).alias("next_page"))


def fields(html: Column) -> Column:
    """Labels and values of a definition list, or of label and value spans, as a map."""
    pairs = F.regexp_extract_all(html, F.lit(r"(?is)<dt[^>]*>(.*?)</dt>"), F.lit(1)), F.regexp_extract_all(html, F.lit(r"(?is)<dd[^>]*>(.*?)</dd>"), F.lit(1))
    strip = lambda x: text.squeezed(text.unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", " ")))
    entries = F.arrays_zip(F.transform(pairs[0], lambda x: F.rtrim(F.lower(strip(x)), F.lit(":"))).alias("k"), F.transform(pairs[1], strip).alias("v"))
    kept = F.filter(entries, lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    keys = F.array_distinct(F.transform(kept, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(kept, lambda e: e["k"] == k)[0]["v"]))


def field_of(page_text: Column, label: str, until: list[str]) -> Column:
    """The value behind a label in running text, up to the next label."""
    stop = "|".join(until)
    return F.trim(F.regexp_extract(page_text, rf"(?is)\b{label}\s*:?\s*(.*?)(?:\s+(?:{stop})\s*:|$)", 1))


SIZE = r"(£\d+(?:\.\d+)?[km]?\+?)"


def cards(pages: DataFrame) -> DataFrame:
    """(page_id, place, title, href, fields, size) of articles with a definition list, or of headings with what follows where a page has none."""
    articles = F.regexp_extract_all("html", F.lit(r"(?is)<article\b[^>]*>(.*?)</article\s*>"), F.lit(1))
    headed = F.regexp_extract_all("html", F.lit(r"(?is)(<h[2-4]\b[^>]*>.*?</h[2-4]\s*>(?:(?!<h[2-4]\b|<hr).)*)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(F.when(F.size(articles) > 0, articles).otherwise(headed)).alias("place", "card"))
    strip = lambda x: text.squeezed(text.unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", " ")))
    title = strip(F.regexp_extract("card", r"(?is)<h[2-4]\b[^>]*>(.*?)</h[2-4]\s*>", 1))
    return rows.select("page_id", "place", title.alias("title"), F.regexp_extract("card", r"(?is)<a\s[^>]*href=[\"']([^\"']+)[\"']", 1).alias("href"), fields(F.col("card")).alias("fields"), F.regexp_extract(strip(F.col("card")), SIZE, 1).alias("size"))


def enriched(rows: DataFrame, details: DataFrame) -> DataFrame:
    """rows (id, title, deadline_raw, funding_amount, organization, summary) with what is blank read from their own pages, details (id, html)."""
    page = details.select("id", text.html_text(F.col("html")).alias("_text"))
    given = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    told = F.coalesce("_text", F.lit(""))
    return (
        rows.join(page, "id", "left")
        .withColumn("deadline_raw", F.coalesce(given("deadline_raw"), F.substring(F.regexp_extract(told, DEADLINE, 1), 1, 64)))
        .withColumn("funding_amount", F.coalesce(given("funding_amount"), amounts.extracted(told)))
        .withColumn("organization", F.coalesce(given("organization"), organizations.extracted(told, F.col("title"))))
        .withColumn("summary", F.coalesce(given("summary"), F.when(F.length(told) > 120, F.substring(told, 1, 1000)).otherwise("")))
        .drop("_text")
    )


def parsed_cards(pages: DataFrame, tag: str = "article") -> DataFrame:
    """Cards as maps of their labelled parts, by the standard library's parser in Arrow batches."""

    def run(batches: Iterator) -> Iterator:
        from html.parser import HTMLParser

        import pandas as pd

        class Cards(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.depth, self.cards, self.part = 0, [], ""

            def handle_starttag(self, name, attrs):
                known = dict(attrs)
                if name == tag:
                    self.depth += 1
                    if self.depth == 1:
                        self.cards.append({})
                self.part = (known.get("class") or name).split()[0]
                if self.depth and name == "a" and known.get("href"):
                    self.cards[-1].setdefault("href", known["href"])

            def handle_endtag(self, name):
                self.part = ""
                if name == tag and self.depth:
                    self.depth -= 1

            def handle_data(self, data):
                data = " ".join(data.split())
                if self.depth and self.part and data:
                    old = self.cards[-1].get(self.part)
                    self.cards[-1][self.part] = f"{old} {data}" if old else data

        for frame in batches:
            out = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                parser = Cards()
                parser.feed(html or "")
                out += [(page_id, card) for card in parser.cards if card]
            yield pd.DataFrame(out, columns=["page_id", "fields"])

    return pages.select("page_id", "html").mapInPandas(run, CARDS)


def page_fingerprint(items: DataFrame) -> DataFrame:
    """(source, page, fingerprint): equal for pages that hold the same items in any order."""
    key = F.coalesce(F.nullif("url", F.lit("")), "title")
    return items.groupBy("source", "page").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "|"), 256).alias("fingerprint"))
