"""Organisations: named in text by a few phrasings, proven by an institutional word."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, squeezed

# Words that prove an institution, names too vague to stand alone, and words that begin no name.
MARKERS = r"foundation|trust|council|commission|ministry|minist[eè]re|agency|association|institute|institution|university|college|society|bank|department|authority|corporation|cent(?:er|re)|network|alliance|federation|consortium|organi[sz]ation|office|secretariat|bureau|charity|charitable|endowment|philanthrop|embassy|government|municipal|united\s+nations|european\s+(?:commission|union)|world\s+(?:bank|food|health)|development\s+programme|environment\s+programme|fonds|fonden|stiftung|fundaci[oó]n"
VAGUE = ["civil society", "society", "government", "the government", "european union", "united nations", "embassy", "council", "foundation", "trust", "network", "commission", "ministry", "agency", "university", "institute", "bank"]
VAGUE_END = ["civil society", "the government"]
STOP_FIRST = ["the", "a", "an", "this", "it", "they", "we", "applications", "apply", "grants", "grant", "funding", "fund", "program", "programme", "opportunity", "deadline", "eligible", "interested", "organizations", "proposals", "successful", "selected", "all", "each", "ai", "snippet", "summary"]
# What stands in front of a summary, a clause between a name and its verb and one behind a name, and words of schemes behind a name.
LEAD = r"(?i)^(?:\s*deadline\s*:\s*\S+)?\s*(?:ai\s+snippet\s+summary\s*:?\s*)?"
APPOSITIVE, CLAUSE = r"(?i),\s+(?:that|which|who)\s+[^,]{0,80},\s*", r"(?i),\s+(?:ha[sv]e?|is|are|will|which|who|that|and\s+its)\b.*$"
SCHEME = r"(?i)(?:\s*\((?:round|cycle|phase)\s*[\w\s]*\))?(?:\s+(?:grants?|programmes?|programs?|funds?|funding|schemes?|fellowships?|scholarships?|awards?|prizes?|competitions?|challenges?|accelerators?|residenc(?:y|ies)|subsid(?:y|ies)|bursar(?:y|ies)|calls?|rounds?|cycles?)){1,40}$"
# Words that join the parts of a name, and the institutions that a title names outright.
JOINING = ["for", "of", "on", "in", "de", "du", "des", "della", "del", "the", "aux", "and"]
IN_TITLE = ["Foundation", "Trust", "Council", "Commission", "Ministry", "Agency", "Association", "Institute", "University", "Society", "Bank", "Department", "Authority", "Network", "Embassy"]
# Phrasings that name who gives; each with whether it alone proves an institution.
_CAPITAL = r"[A-Z][\w&.,'’()\-]*"
PHRASINGS = [
    (rf"\bby\s+(?:the\s+)?({_CAPITAL}(?:\s+[A-Z(][\w&.,'’()\-]*){{0,6}})\s+(?:provides|offers|supports|aims|seeks|invites)\b", True),
    (rf"\b(?:offered|funded|administered|launched|managed|supported|implemented|run|provided|established|created|sponsored)\s+by\s+(?:the\s+)?({_CAPITAL}(?:\s+[A-Z(a-z][\w&.,'’()\-]*){{0,8}})", True),
    (rf"(?:^|(?<=[.•]\s))\s*(?:The\s+)?({_CAPITAL}(?:\s+(?:of|for|and|the|de|du|des|on|in)|\s+[A-Z(][\w&.,'’()\-]*){{0,12}})\s+(?:is\s+(?:inviting|accepting|seeking|requesting|calling|offering|pleased|now\s+accepting)|invites|announces|announced|has\s+(?:launched|opened|announced)|seeks|offers|provides)\b", False),
]
SCANNED, LONGEST = 600, 200
_EDGES = r"^[ ,.;:\-–—]+|[ ,.;:\-–—]+$"


def _once(x: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once, however often use asks."""
    return F.transform(F.array(x), use)[0]


def _name(found: Column) -> Column:
    """A candidate without words that begin no name; blank where it is too short or long, or mostly lower case, as prose is."""
    article = r"(?i)^(?:The|A|An)\s+"

    def begun(words: Column) -> Column:
        first = F.array_position(F.transform(words, lambda w: w.rlike(rf"^[,.]*(?i:{'|'.join(STOP_FIRST)})[,.]*$")), F.lit(False))
        return F.when(first > 0, F.array_join(F.slice(words, F.greatest(first, F.lit(1)).cast("int"), F.size(words)), " ")).otherwise("")

    def named(n: Column) -> Column:
        words = F.split(n, " ")
        capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        return F.when(F.length(n).between(3, 120) & (capital >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))), n).otherwise("")

    words = F.split(F.regexp_replace(F.regexp_replace(squeezed(found), _EDGES, ""), article, ""), " ")
    return _once(F.regexp_replace(_once(words, begun), article, ""), named)


def _to_the_institution(name: Column) -> Column:
    """A name cut behind the first institution word that nothing continues: no bracket, further such word, or joining word before a capital."""

    def cut(words: Column) -> Column:
        word = lambda i: F.coalesce(F.get(words, i), F.lit(""))

        def ends(i: Column) -> Column:
            goes_on = word(i + 1).rlike(rf"^\(|^[,.]*(?i:{MARKERS})[,.]*$") | (word(i + 1).rlike(rf"^[,.]*(?i:{'|'.join(JOINING)})[,.]*$") & word(i + 2).rlike(r"^\p{Lu}"))
            return word(i).rlike(rf"^[’'s,.()]*(?i:{MARKERS})[’'s,.()]*$") & ~goes_on

        at = F.get(F.filter(F.sequence(F.lit(0), F.size(words) - 1), ends), F.lit(0))
        return F.array_join(F.slice(words, F.lit(1), F.coalesce(at + 1, F.size(words))), " ")

    return F.regexp_replace(_once(F.split(name, " "), cut), r"^[ ,.;:\-]+|[ ,.;:\-]+$", "")


def _sure(name: Column) -> Column:
    """A name that is long enough and not too vague, else blank."""
    vague = rf"(?i)^\s*(?:{'|'.join(VAGUE)})\s*$|(?:{'|'.join(VAGUE_END)})\s*$"
    return F.when((F.length(name) >= 4) & ~name.rlike(vague), name).otherwise("")


def _settled(found: Column, proven: bool) -> Column:
    """The institution that a candidate names; blank where nothing proves one."""
    cut_at_marker = lambda x, other: F.when(x.rlike(rf"(?i)\b(?:{MARKERS})\b"), _to_the_institution(x)).otherwise(other)

    def judged(c: Column) -> Column:
        short = F.regexp_replace(c, r"^(.*?\([A-Z]{2,8}\))\s+\S.*$", "$1")
        bare = F.regexp_replace(F.regexp_replace(c, SCHEME, ""), _EDGES, "")
        by_word = _once(F.when(bare == "", c).otherwise(bare), lambda x: cut_at_marker(x, x if proven else F.lit("")))
        return F.when(c.rlike(r"\([A-Z]{2,8}\)|^[A-Z]{2,8}$"), _once(short, lambda x: cut_at_marker(x, x))).otherwise(by_word)

    c = F.regexp_replace(F.regexp_replace(_name(found), CLAUSE, ""), _EDGES, "")
    return _once(_once(c, judged), _sure)


def extracted(summary: Column, title: Column) -> Column:
    """The organisation a summary, or else a title, names; blank when none is sure."""
    text = F.substring(F.regexp_replace(F.regexp_replace(squeezed(summary), LEAD, ""), APPOSITIVE, " "), 1, SCANNED)
    found = lambda t: F.coalesce(*(F.nullif(_settled(F.regexp_extract(t, pattern, 1), proven), F.lit("")) for pattern, proven in PHRASINGS))
    named = F.regexp_extract(blank(title), rf"([A-Z][\w&.'’\-]*(?:\s+[A-Z][\w&.'’\-]*){{0,5}}\s+(?:{'|'.join(IN_TITLE)}))", 1)
    cut = _once(_to_the_institution(F.trim(named)), lambda x: F.when(F.length(x) <= 120, F.nullif(_sure(x), F.lit(""))))
    return F.coalesce(_once(text, found), cut, F.lit(""))


def tidied(x: Column, limit: int = LONGEST) -> Column:
    """At most limit characters: whole comma parts and how many more there are, else cut at a word."""
    v = F.regexp_replace(squeezed(x), r"^[ ,;]+|[ ,;]+$", "")
    parts = F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda p: p != "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(acc: Column, p: Column) -> Column:
        grown = F.when(acc["n"] == 0, p).otherwise(F.concat(acc["text"], F.lit(", "), p))
        stop = acc["full"] | (F.length(grown) > limit - 15)
        return F.struct(F.when(stop, acc["text"]).otherwise(grown).alias("text"), F.when(stop, acc["n"]).otherwise(acc["n"] + 1).alias("n"), stop.alias("full"))

    kept = F.aggregate(parts, start, add)
    more = F.size(parts) - kept["n"]
    listed = F.concat(kept["text"], F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    cut = F.concat(F.regexp_replace(F.substring(v, 1, limit - 1), r"\s+\S*$", ""), F.lit("…"))
    return F.when(F.length(v) <= limit, v).when((F.size(parts) > 1) & (kept["n"] > 0), listed).otherwise(cut)
