"""Links: is it usable, what does it point at, what to offer instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, squeezed

# Paths of listing pages, search queries, endpoints with a page of their own, search pages by source.
LISTING_PATH = r"(?i)/(funding|grants?|tenders?|opportunit(y|ies)|calls?(-for-[\w-]+)?|rfp\w*|programs?|programmes?|apply|how-to-apply|search|search-results|grants-funding|funding-opportunities|open-calls?)/?$"
SEARCH_QUERY = r"(?i)[?&](s|q|search|keyword)="
MANY_IDS = r"/view/\d+(?:,\d+)+/?$"
REWRITES = [
    (r"(?i)^(https://(?:www\.)?unpartnerportal\.org)/api/public/export/projects/(\d+)/?$", "$1/landing/opportunities/$2/"),
    (r"(?i)^(https://(?:www\.)?unpartnerportal\.org)/api/public/projects/(\d+)/?$", "$1/landing/opportunities/$2/"),
]
SEARCH_PAGES = {
    "DevelopmentAid": "https://www.developmentaid.org/tenders/search?keywords=",
    "UNDP Procurement": "https://procurement-notices.undp.org/search.cfm?keywords=",
    "UN Partner Portal": "https://www.unpartnerportal.org/landing/opportunities/?search=",
    "World Bank": "https://projects.worldbank.org/en/projects-operations/procurement?searchTerm=",
    "ADB Tenders": "https://www.adb.org/projects/tenders?searchstax%5Bquery%5D=",
    "FundsForNGOs": "https://www2.fundsforngos.org/?s=",
    "Bond UK": "https://www.bond.org.uk/search/?keywords=",
    "NGOBOX": "https://ngobox.org/search.php?q=",
    "GrantWatch Intl": "https://www.grantwatch.com/cat/search.php?keyword=",
}
SEARCH_PAGES_FIXED = {"DevNetJobsIndia": "https://www.devnetjobsindia.org/rfp_assignments.aspx"}
TITLE_LENGTH = 180


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def host(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)


def query_string(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def bare(u: Column) -> Column:
    return F.regexp_replace(u, "/+$", "")


def is_root(u: Column) -> Column:
    return (F.regexp_replace(path(u), "/", "") == "") & (query_string(u) == "")


def usable(url: Column, website: Column) -> Column:
    """Points at one page below a host: not a root, not many ids, not the site's own homepage."""
    u, site = F.trim(blank(url)), blank(website)
    web = u.rlike(r"^https?://[^/?#]+")
    return web & ~is_root(u) & ~u.rlike(MANY_IDS) & ~((site != "") & (bare(u) == bare(site)))


def kind(url: Column) -> Column:
    """deep, listing or blank, by the form of the URL alone."""
    u = F.trim(blank(url))
    way = bare(path(u))
    depth = F.size(F.filter(F.split(way, "/"), lambda s: s != ""))
    listing = u.rlike(SEARCH_QUERY) | way.rlike(LISTING_PATH) | ((depth <= 1) & (query_string(u) == ""))
    return F.when(u == "", "").when(listing, "listing").otherwise("deep")


def canonical(url: Column) -> Column:
    u = F.trim(blank(url))
    for pattern, to in REWRITES:
        u = F.regexp_replace(u, pattern, to)
    return u


def search(title: Column, website: Column, source: Column) -> Column:
    """The source's search for a title, else a search within the site, else the homepage."""
    q = F.url_encode(F.substring(squeezed(title), 1, TITLE_LENGTH))
    pages = F.create_map(*(F.lit(x) for kv in SEARCH_PAGES.items() for x in kv))
    fixed = F.create_map(*(F.lit(x) for kv in SEARCH_PAGES_FIXED.items() for x in kv))
    s, site = F.trim(blank(source)), F.trim(blank(website))
    own = F.coalesce(F.concat(F.try_element_at(pages, s), q), F.try_element_at(fixed, s))
    within = F.when(host(site) != "", F.concat(F.lit("https://duckduckgo.com/?q=site%3A"), host(site), F.lit("+"), q))
    return F.when(q == "", site).otherwise(F.coalesce(own, within, site))


def resolved(url: Column, website: Column, source: Column, title: Column) -> Column:
    """(url, kind): the link itself when usable, else a search."""
    direct = usable(url, website)
    return F.struct(F.when(direct, url).otherwise(search(title, website, source)).alias("url"), F.when(direct, "direct").otherwise("search").alias("kind"))


def repaired(url: Column, website: Column) -> Column:
    """Rewritten where a rule is known, blank where unusable."""
    u = canonical(url)
    return F.when(usable(u, website), u).otherwise("")
