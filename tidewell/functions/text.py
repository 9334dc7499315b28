"""Text: normal forms, fingerprints, spam, titles, HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(blank(x), r"\s+", " "))


def normal(x: Column) -> Column:
    return F.lower(squeezed(x))


def unique_id(title: Column, organization: Column, deadline: Column, url: Column) -> Column:
    """SHA-256 over normal title, organisation, ISO deadline and URL; unlike values never share a key by a null."""
    parts = [normal(title), normal(organization), F.coalesce(F.date_format(deadline, "yyyy-MM-dd"), F.lit("")), normal(url)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def body(*parts: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", *(F.when(blank(p) != "", p) for p in parts))


def csv(x: Column) -> Column:
    return F.filter(F.transform(F.split(blank(x), ","), lambda x: F.trim(x)), lambda t: t != "")


def joined(x: Column) -> Column:
    return F.array_join(x, ", ")


# Whole titles that are page furniture.
FURNITURE = [
    "skip to main content", "skip to content", "procurement policy", "cookie policy", "privacy policy", "privacy notice",
    "terms of use", "terms and conditions", "sign in", "sign up", "register", "log in", "login", "contact us", "contact",
    "subscribe", "newsletter", "feedback survey", "news and events", "site map", "sitemap", "accessibility", "back to top",
    "read more", "learn more", "apply now", "view all", "see all", "download", "share this page",
    "frequently asked questions", "about us", "our work", "what we do",
]
# What advertisements say, and the scripts that no source publishes in.
SPAM_TERMS = (
    r"(?is)\b(?:cytotec|misoprostol|mifepristone|mifepristol)\b.{0,60}\b(?:buy|sale|for sale|pills?|order|price|delivery|whatsapp)\b"
    r"|\b(?:buy|order)\b.{0,40}\b(?:abortion|cytotec|misoprostol)\b"
    r"|حبوب\s+الإجهاض"
    r"|\b(?:penis|viagra|cialis|casino|escort|forex signals)\b"
)
CONTACT_WORDS = r"(?i)whatsapp|واتساب|اتصل|call now|contact us"
NON_LATIN = r"[֐-׿؀-ۿݐ-ݿﭐ-﷿ﹰ-\uFEFFЀ-ӿऀ-ॿ฀-๿一-鿿぀-ヿ가-힯]"
NON_LATIN_SHARE, NON_LATIN_LETTERS, PHONE_DIGITS, SPAM_SUMMARY = 0.20, 8, 9, 500


def furniture(title: Column) -> Column:
    return F.lower(F.regexp_replace(squeezed(title), r"^[.:–-]+|[.:–-]+$", "")).isin(FURNITURE)


def has_phone(x: Column) -> Column:
    plus = F.exists(F.regexp_extract_all(blank(x), F.lit(r"(\+\d[\d\s\-().]{6,}\d)"), F.lit(1)), lambda m: F.length(F.regexp_replace(m, r"\D", "")) >= PHONE_DIGITS)
    return plus | (blank(x).rlike(r"\b\d{9,}\b") & blank(x).rlike(CONTACT_WORDS))


def mostly_foreign(x: Column) -> Column:
    letters = F.regexp_replace(blank(x), r"[^\p{L}]", "")
    foreign = F.length(letters) - F.length(F.regexp_replace(letters, NON_LATIN, ""))
    return (F.length(letters) >= NON_LATIN_LETTERS) & (foreign / F.greatest(F.length(letters), F.lit(1)) >= NON_LATIN_SHARE)


def spam(title: Column, summary: Column) -> Column:
    t = F.trim(blank(title))
    terms = t.rlike(SPAM_TERMS) | F.substring(blank(summary), 1, SPAM_SUMMARY).rlike(SPAM_TERMS)
    return (t != "") & (has_phone(t) | furniture(t) | mostly_foreign(t) | terms)


def junk_title(title: Column) -> Column:
    """Rows that look like page furniture, for a report."""
    t = F.trim(blank(title))
    # Titles of menus.
    menu = ["skip to main content", "read more", "apply now", "click here", "learn more", "subscribe", "menu", "home"]
    return t.rlike(r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$") | F.lower(t).isin(menu) | (F.length(t) < 8)


def numeric_only(x: Column) -> Column:
    return F.trim(blank(x)).rlike(r"^[0-9, ]*[0-9][0-9, ]*$")


def cleaned_title(x: Column) -> Column:
    """Without a leading label, spaces collapsed."""
    return squeezed(F.regexp_replace(squeezed(x), r"(?i)^(?:title|name|position|project title|subject)\s*[:\-–]\s*", ""))


def shortened(x: Column, limit: int) -> Column:
    """Cut at a word with an ellipsis when longer than the limit."""
    s = squeezed(x)
    cut = F.substring(s, 1, limit - 1)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.when(cut.contains(" "), F.regexp_replace(cut, r"\s+\S*$", "")).otherwise(cut), F.lit("…")))


def display_name(email: Column) -> Column:
    return F.initcap(F.regexp_replace(F.substring_index(email, "@", 1), r"[._-]+", " "))


def listing_title(x: Column) -> Column:
    """Long enough, short enough, not shouting: looks like a title of a listing."""
    t = squeezed(x)
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    return F.length(t).between(18, 300) & ~furniture(t) & (upper <= 0.8 * F.length(letters))


def suffix_country(title: Column) -> Column:
    """What stands in brackets at the end, unless it is money, a year or a round."""
    inner = F.trim(F.regexp_extract(blank(title), r"\(([^()]{2,60})\)\s*$", 1))
    return F.when(inner.rlike(r"(?i)[$€£₹¥0-9]|\b(round|cycle|phase|edition|usd|eur|gbp|inr)\b"), "").otherwise(inner)


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#8217;", "’"), ("&#8211;", "–"), ("&amp;", "&")]


def unescaped(x: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ENTITIES, x)


def html_text(x: Column, limit: int = 20_000) -> Column:
    """Text of a page without scripts, styles and frame parts."""
    bare = F.regexp_replace(blank(x), r"(?is)<(script|style|nav|header|footer)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.substring(squeezed(unescaped(bare)), 1, limit)
