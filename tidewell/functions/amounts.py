"""Funding amounts: cleaning, extraction from text, conversion to one currency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, squeezed

# How currencies and figures are written, what says nothing, what is glued on.
CURRENCY = r"(?:US\$|A\$|C\$|NZ\$|R\$|USD|EUR|GBP|INR|CHF|AUD|CAD|NZD|ZAR|SEK|NOK|DKK|JPY|CNY|KES|NGN|PHP|SGD|THB|IDR|BRL|MXN|Rs\.?|€|£|\$|₹|¥)"
FIGURE = r"\d[\d,.\s]*(?:\.\d+)?\s*(?:k\b|m\b|bn\b|million|billion|thousand|lakh|crore)?"
AMOUNT = rf"(?:{CURRENCY}\s?{FIGURE}|{FIGURE}\s?{CURRENCY})"
NOTHING = ["", "n/a", "na", "none", "not applicable", "not specified", "unspecified", "other", "others", "tbd", "tba", "varies", "various", "unknown", "-", "--", "not disclosed", "confidential", "0"]
GLUED = r"(?i)\s*(?:add to (?:google )?calendar|deadline\s*:.*|share\b.*|read more.*|apply now.*|view details.*|click here.*)$"
CODES = "USD|EUR|GBP|INR|CHF|AUD|CAD|NZD|ZAR|SEK|NOK|DKK|JPY|CNY|KES|NGN|PHP|SGD|THB|IDR|BRL|MXN"
# Patterns of one or two amounts, and the text in front; the first that is found counts. Words that tell an award.
PHRASES = [
    (rf"\b(?:ranging\s+)?from\s+({AMOUNT})\s*(?:to|–|—|-|and)\s*({AMOUNT})", ""),
    (rf"\bbetween\s+({AMOUNT})\s*(?:to|and|–|—|-)\s*({AMOUNT})", ""),
    (rf"({AMOUNT})\s*(?:to|–|—)\s*({AMOUNT})", ""),
    (rf"\bup\s+to\s+({AMOUNT})", "up to "),
    (rf"\b(?:maximum|max\.?|as much as|worth)\s+(?:of\s+)?({AMOUNT})", "up to "),
    (rf"\b(?:grants?|awards?|funding|budget|amount|support|prize)\s+(?:of|is|:)\s+({AMOUNT})", ""),
    (rf"\bprovides?\s+({AMOUNT})", ""),
    (rf"({AMOUNT})", ""),
]
AWARD_WORDS = r"(?i)\b(grant|award|fund|funding|budget|support|prize|financ|invest)"
LONGEST = 256
# Rupees for one unit, and the order in which currencies are looked for.
RATES = {"INR": 1.0, "USD": 87.5, "EUR": 95.0, "GBP": 111.0, "AUD": 57.0, "CAD": 63.0, "CHF": 99.0, "SGD": 65.0, "JPY": 0.58, "ZAR": 4.8, "KES": 0.68, "SEK": 8.4, "NOK": 8.2, "DKK": 12.7}
CURRENCY_TOKENS = [(r"\b(?:INR|Rs\.?|₹)", "INR"), (r"\b(?:AUD|A\$|AU\$)", "AUD"), (r"\b(?:CAD|CA\$|C\$)", "CAD"), (r"\b(?:SGD|S\$)", "SGD"), (r"\bCHF\b", "CHF"), (r"\bZAR\b", "ZAR"), (r"\bKES\b", "KES"), (r"\bSEK\b", "SEK"), (r"\bNOK\b", "NOK"), (r"\bDKK\b", "DKK"), (r"\bJPY|¥", "JPY"), (r"\bGBP|£", "GBP"), (r"\bEUR|€", "EUR"), (r"\b(?:USD|US\$)", "USD"), (r"\$", "USD")]
MULTIPLIERS = [(r"crores?|cr", 1e7), (r"lakhs?|lacs?", 1e5), (r"billion|bn|b", 1e9), (r"million|mn|m", 1e6), (r"thousand|k", 1e3)]


def tidy(x: Column) -> Column:
    """Symbols close to their figure, codes a space before it."""
    v = F.regexp_replace(squeezed(x), r"^[ ,.;:\-–—]+|[ ,.;:\-–—]+$", "")
    v = F.regexp_replace(v, r"([€£$₹¥])\s+", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(v, rf"(?i)\b({CODES})\s*", "$1 "), r"\s+", " "))


def cleaned(x: Column) -> Column:
    """An amount as given by a source, or blank when it says nothing."""
    v = F.regexp_replace(F.regexp_replace(squeezed(x), GLUED, ""), r"^[ ,;:-]+|[ ,;:-]+$", "")
    upto = F.regexp_extract(v, rf"(?i)^(.*{AMOUNT})", 1)
    cut = F.when(upto != "", F.regexp_replace(upto, r"[ ,;:-]+$", "")).otherwise(v)
    nothing = F.regexp_replace(F.lower(v), r"^[ .]+|[ .]+$", "").isin(NOTHING) | ~v.rlike(r"\d")
    return F.when(nothing, "").otherwise(F.substring(tidy(cut), 1, LONGEST))


def extracted(*texts: Column) -> Column:
    """An amount stated in text, or blank."""
    blob = squeezed(F.concat_ws(" ", *(F.when(blank(t) != "", t) for t in texts)))
    out = None
    for pattern, front in reversed(PHRASES):
        found = blob.rlike(f"(?i){pattern}")
        one = tidy(F.regexp_extract(blob, f"(?i){pattern}", 1))
        if pattern == PHRASES[-1][0]:
            value = F.when(blob.rlike(AWARD_WORDS), one).otherwise("")
        elif ")\\s*(?:to" in pattern:
            value = F.concat(one, F.lit(" – "), tidy(F.regexp_extract(blob, f"(?i){pattern}", 2)))
        else:
            value = F.concat(F.lit(front), one)
        out = F.when(found, value).otherwise("" if out is None else out)
    return F.when(blob.rlike(f"(?i){CURRENCY}"), F.substring(out, 1, LONGEST)).otherwise("")


def currency(x: Column) -> Column:
    return F.coalesce(*(F.when(x.rlike(f"(?i){p}"), code) for p, code in CURRENCY_TOKENS))


def figures(x: Column) -> Column:
    """All amounts in a text as doubles, with k, million, lakh and the like applied."""
    units = "|".join(p for p, _ in MULTIPLIERS)
    parts = F.regexp_extract_all(blank(x), F.lit(rf"(?i)(\d[\d,]*(?:\.\d+)?(?:\s*(?:{units})\b)?)"), F.lit(1))

    def value(part: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(part, r"^(\d[\d,]*(?:\.\d+)?)", 1), ",", "").cast("double")
        unit = F.lower(F.trim(F.regexp_replace(part, r"^\d[\d,]*(?:\.\d+)?", "")))
        factor = reduce(lambda rest, m: F.when(unit.rlike(f"^(?:{m[0]})$"), m[1]).otherwise(rest), reversed(MULTIPLIERS), F.lit(1.0))
        return number * factor

    return F.filter(F.transform(parts, value), lambda v: v > 0)


def rupees(v: Column) -> Column:
    """Compact Indian notation."""
    crore, lakh = v / 1e7, v / 1e5
    grouped = F.regexp_replace(F.round(v).cast("long").cast("string"), r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    big = F.when(crore >= 10, F.round(crore).cast("long").cast("string")).otherwise(F.format_string("%.1f", crore))
    some = F.when(lakh >= 10, F.round(lakh).cast("long").cast("string")).otherwise(F.format_string("%.1f", lakh))
    return F.when(v >= 1e7, F.concat(F.lit("₹"), big, F.lit(" Cr"))).when(v >= 1e5, F.concat(F.lit("₹"), some, F.lit(" L"))).otherwise(F.concat(F.lit("₹"), grouped))


def in_rupees(x: Column) -> Column:
    """An approximate range in rupees, blank without a known foreign currency and a figure."""
    rate = F.create_map(*(F.lit(y) for kv in RATES.items() for y in kv))
    code, values = currency(blank(x)), figures(x)
    lo, hi = rupees(F.array_min(values) * rate[code]), rupees(F.array_max(values) * rate[code])
    text = F.when(lo == hi, F.concat(F.lit("≈ "), lo)).otherwise(F.concat(F.lit("≈ "), lo, F.lit(" – "), hi))
    return F.when(code.isNull() | (code == "INR") | (F.size(values) == 0), "").otherwise(text)
