"""Surrogates for personal data, in DataFrame and SQL functions alone.

One regular expression finds mail addresses, phone, card (where the check digit is right), bank and
social security numbers, IPv4 addresses, secrets (to the end of the value, however long) and names: up to four capital
words after an honorific, up to two after a listed given name. Wherever a word of such a name
stands again in the same document it is replaced too. Each entity has a canonical form (case
folded, separators dropped), so its spellings are one entity. A keyed SHA-512 of kind and
canonical form gives the surrogate of the same format: digits stay digits and letters letters of
the same case and script, phones keep their country code, cards their Luhn remainder, and given
names stay with their gender (of the list, or of the honorific in front) and script. Names are
replaced word by word, so a surname alone still points at the same person. An initial stays.

Surrogates are checked over the whole corpus: two entities never share one, and none equals an
entity that occurs. What collides is drawn again, and after a few draws grows by a digit or a
letter with each, so a crowded format always finds room.

Only the rows with entities and the distinct entities are shuffled. The few entities that make
up more than a thousandth of all are joined by broadcast (there are at most a thousand), so a
frequent name gathers in no task. Rows are told apart by an id of their own, so repeated rows and
repeated or missing doc_ids each come back once. A null text stays null, an empty one empty; other
columns are kept, also where their names are those used here. Texts of any length are searched whole; a
mail domain of more than 126 labels, or a word of more than nine hyphenated parts, ends there. Whoever holds the key can make the
surrogates again, so there is no default.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, release, written

#: The setting that names op10's key; without it each run draws one.
KEY_SETTING = "spark.tidewell.pii.key"
WIDER_AFTER = 4
DRAWS = 40
HOT_SHARE = 1000

# Honorifics and given names by gender and script, from everyday use.
HONORIFICS = {"m": ["Mr", "Herr", "Herrn", "Señor", "Don", "Monsieur", "Sir", "Lord"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Doña", "Madame", "Mademoiselle", "Mme", "Lady"], "": ["Dr", "Prof", "Professor", "Doctor"]}
GIVEN = {
    "f latin": ["Alexandra", "Alice", "Amelia", "Beatrice", "Beatriz", "Camille", "Carmen", "Caroline", "Catherine", "Charlotte", "Christine", "Claire", "Dorothy", "Elena", "Elizabeth", "Emma", "Francesca", "Gabriela", "Giulia", "Guadalupe", "Hannah", "Isabel", "Jessica", "Johanna", "Julia", "Katharina", "Katherine", "Laura", "Lucia", "Margaret", "Maria", "Mercedes", "Michelle", "Monika", "Nina", "Olivia", "Patricia", "Penelope", "Rebecca", "Samantha", "Sarah", "Sofia", "Stephanie", "Susanne", "Teresa", "Valentina", "Victoria", "Virginia"],
    "m latin": ["Alejandro", "Alexander", "Andrew", "Anthony", "Benjamin", "Carlos", "Charles", "Christopher", "Daniel", "David", "Diego", "Edward", "Felix", "Fernando", "Francesco", "Francisco", "Frederick", "Friedrich", "Gabriel", "Giovanni", "Heinrich", "Henri", "James", "Javier", "Johann", "John", "Jonathan", "Joseph", "Louis", "Lukas", "Matthew", "Matthias", "Michael", "Miguel", "Nicholas", "Pablo", "Patrick", "Paul", "Rafael", "Richard", "Robert", "Sebastian", "Thomas", "Timothy", "Vincent", "William", "Wolfgang", "Zachary"],
    "f cyrillic": ["Александра", "Анастасия", "Анна", "Вера", "Виктория", "Галина", "Дарья", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    "m cyrillic": ["Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Дмитрий", "Евгений", "Иван", "Константин", "Михаил", "Николай", "Павел", "Пётр", "Сергей", "Юрий"],
}
#: Groups repeat so many times at most: Java's matcher recurses for each, and a long text must not end an executor.
PARTS, LABELS = 8, 126
_WORD = rf"\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:[-'’](?!s(?![\p{{L}}\p{{M}}]))\p{{L}}[\p{{L}}\p{{M}}]*+){{0,{PARTS}}}+"
_PART = rf"(?:\p{{Lu}}\.|{_WORD})"
_HON = "|".join(x for names in HONORIFICS.values() for x in names)
_NAMES = "|".join(x for names in GIVEN.values() for x in names)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_PREFIX = r"(?i:password|passwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?"
_VALUE = r"(?:[^\s\"']{12,}+|(?=[^\s\"'0-9]*+[0-9])[^\s\"']{4,}+)"  # a short one has a digit
_MAIL = r"A-Za-z0-9._%+\-\u00C0-\u024F\u0400-\u04FF"
#: Kind -> pattern, in the order in which they are tried.
PATTERNS = {
    "email": rf"(?<![{_MAIL}])[{_MAIL}]++@(?:[A-Za-z0-9-]++\.){{1,{LABELS}}}[A-Za-z]{{2,}}+",
    "secret": rf"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}(?![0-9A-Z])|{_PREFIX}{_VALUE})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?!\w)",
    "called": rf"(?<![\p{{L}}\p{{N}}])(?:{_HON})\.? {_PART}(?: {_PART}){{0,3}}+",
    "named": rf"(?<![\p{{L}}\p{{N}}])(?:{_NAMES})(?:-{_WORD})?(?: {_PART}){{1,2}}+",
}
#: How telephone country codes are told, one digit (zones 1 and 7), two or three.
COUNTRY_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}|[0-9]{1,2}(?=[ .(-]))"
#: What an entity's first character can be, where that rules out most places before anything else is tried.
_FIRST = {"iban": "[A-Z]", "phone": "[0-9+(]", "ip": "[0-9]", "ssn": "[0-9]", "card": "[0-9]", "called": r"\p{Lu}", "named": r"\p{Lu}", "secret": "[A-Za-z]"}
ANY = "|".join(f"(?:{f'(?={_FIRST[k]})' if k in _FIRST else ''}(?:{p}))" for k, p in PATTERNS.items())
#: A capital word that no entity can begin in: it may be a name that the document gave before.
_BARE = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}]){_WORD}(?!\s?[=:]|\.?[\p{{L}}\p{{M}}\p{{N}}@%+_-])"
ANY_OR_WORD = f"{ANY}|(?:{_BARE})"
#: Holds wherever ANY does (tested for each of PATTERNS), and costs little where it doesn't: a figure, an @, the key of a cloud, a value after = or :, or a name in front.
LIKELY = rf"[0-9@]|AKIA|[=:]\s?[\"']?[^\s\"']{{4}}|(?=[{''.join(sorted({x[0] for names in (*HONORIFICS.values(), *GIVEN.values()) for x in names}))}])(?:{_HON}|{_NAMES})[. -]"


def _listed(names: list[str]) -> str:
    return f"(lower(part) IN ({', '.join(repr(x.lower()) for x in names)}))"


def _described(rows: DataFrame) -> DataFrame:
    """Adds found, the kind of pattern, to rows with raw."""
    kind = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        kind = F.when(F.col("raw").rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return rows.withColumn("found", F.coalesce(kind, F.lit("bare")))


def _parts(rows: DataFrame) -> DataFrame:
    """Rows (uid, place, raw, found) with the parts that are replaced: nth, part, what stands in front (fixed) and kind; words of names by word."""
    front = F.when(F.col("found") == "secret", F.when(F.col("raw").startswith("AKIA"), "AKIA").otherwise(F.regexp_extract("raw", f"^{_PREFIX}", 0)))
    front = front.when(F.col("found") == "phone", F.regexp_extract("raw", COUNTRY_CODE, 0)).when(F.col("found") == "iban", F.substring("raw", 1, 2))
    front = front.when(F.col("found") == "called", F.regexp_extract("raw", rf"^(?:{_HON})\.? ", 0)).otherwise("")
    rows = rows.withColumn("fixed", front).withColumn("rest", F.expr("substring(raw, length(fixed) + 1)"))
    named = F.col("found").isin("called", "named")
    rows = rows.withColumn("words", F.when(named, F.split("rest", " ")).otherwise(F.array("rest")))
    rows = rows.select("uid", "place", "found", F.col("fixed").alias("front"), F.size("words").alias("n_words"), F.posexplode("words").alias("nth", "part"))
    rows = rows.withColumn("fixed", F.when(F.col("nth") == 0, F.col("front")).otherwise(""))
    script = F.when(F.col("part").rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    kind = F.when(F.lit(False), "")
    for name, names in GIVEN.items():
        kind = kind.when(F.expr(_listed(names)), name)
    for gender in "mf":
        own = F.col("front").rlike(rf"^(?:{'|'.join(HONORIFICS[gender])})\.? $")
        kind = kind.when((F.col("found") == "called") & own & (F.col("nth") == 0) & (F.col("n_words") > 1), F.concat(F.lit(f"{gender} "), script))
    kind = F.when(F.col("part").rlike(r"^\p{Lu}\.$"), F.lit(None)).otherwise(F.coalesce(kind, F.concat(F.lit("surname "), script)))
    return rows.withColumn("kind", F.when(named, kind).otherwise(F.col("found")))


def _entities(rows: DataFrame) -> DataFrame:
    """Rows (uid, place, nth, fixed, part, kind, canon) of what is replaced in rows (uid, place, raw, found, again).

    again marks words that are found as part of the whole pattern only to tell names. A word has one
    kind in a document, a given name before a surname, and takes it wherever it stands there.
    """
    parts, parts_at = written(_parts(rows.where("found <> 'bare'")), "pii-parts")
    is_name = F.col("found").isin("called", "named")
    own = parts.where(is_name & F.col("kind").isNotNull()).groupBy("uid", F.lower("part").alias("canon")).agg(F.min("kind").alias("kind"))
    words = parts.where(is_name & (F.col("place") >= 0)).select("uid", "place", "nth", "fixed", "part")
    bare = rows.where("found = 'bare'").select("uid", "place", F.lit(0).alias("nth"), F.lit("").alias("fixed"), F.col("raw").alias("part"))
    both = words.withColumn("stays", F.lit(True)).union(bare.withColumn("stays", F.lit(False))).withColumn("canon", F.lower("part"))
    names = both.join(own, ["uid", "canon"], "left").where("stays OR kind IS NOT NULL")
    digits = F.regexp_replace("part", "[^0-9]", "")
    canon = F.when(F.col("kind").isin("card", "ssn"), digits).when(F.col("kind") == "phone", F.concat(F.regexp_replace("fixed", "[^0-9]", ""), F.lit("/"), digits))
    canon = canon.when(F.col("kind") == "iban", F.concat("fixed", F.regexp_replace("part", " ", ""))).when(F.col("kind") == "email", F.lower("part")).otherwise(F.col("part"))
    columns = ("uid", "place", "nth", "fixed", "part", "kind", "canon")
    found, _ = written(parts.where(~is_name).withColumn("canon", canon).select(*columns).union(names.select(*columns)), "pii-found")
    release(rows.sparkSession, parts_at)
    return found


def _noise(key: str) -> Column:
    """256 keyed bytes in hex, of kind, canon and draw."""
    parts = [F.sha2(F.concat_ws("|", F.lit(f"{key}|{i}"), "kind", "canon", F.col("draw").cast("string")), 512) for i in range(4)]
    return F.concat(*parts)


def _byte(i: str) -> str:
    return f"CAST(conv(substring(noise, 2 * (({i}) % 256) + 1, 2), 16, 10) AS INT)"


def _letters(text: str, offset: int = 0) -> str:
    """Each digit and letter of text replaced by one of its own class."""
    classes = [("[0-9]", "0123456789"), ("[a-f]", "IF_HEX"), ("[aeiou]", "aeiou"), ("[a-z]", "bcdfghjklmnprstvwz"), ("[AEIOU]", "AEIOU"), ("[A-Z]", "BCDFGHJKLMNPRSTVWZ"), ("[аеёиоуыэюя]", "аеиоуя"), ("[а-я]", "бвгдзклмнпрстфх"), ("[А-ЯЁ]", "БВГДЗКЛМНПРСТФХ"), ("[À-ÖØ-Þ]", "ÁÉÍÓÚÀÈÌÒÙÄËÏÖÜ"), ("[ß-öø-ɏ]", "áéíóúàèìòùäëïöü")]
    cases = "".join(f" WHEN {'hex AND ' if to == 'IF_HEX' else ''}c RLIKE '^{rx}$' THEN substring('{'abcdef' if to == 'IF_HEX' else to}', 1 + {_byte(f'i + {offset}')} % {6 if to == 'IF_HEX' else len(to)}, 1)" for rx, to in classes)
    return f"array_join(transform(split({text}, ''), (c, i) -> CASE{cases} ELSE c END), '')"


def _luhn(text: str) -> str:
    """The Luhn sum of a string of digits; the last digit has weight one."""
    digit = f"CAST(substring({text}, length({text}) - i, 1) AS INT)"
    return f"aggregate(transform(sequence(0, length({text}) - 1), i -> IF(i % 2 = 0, {digit}, 2 * {digit} - IF({digit} > 4, 9, 0))), 0, (a, b) -> a + b)"


def _drawn(rows: DataFrame, key: str) -> DataFrame:
    """Adds made, the canonical surrogate of rows (kind, canon, draw)."""
    rows = rows.withColumn("noise", _noise(key)).withColumn("hex", F.expr("kind = 'secret' AND canon RLIKE '^[0-9a-f]+$'")).withColumn("mapped", F.expr(_letters("canon")))
    more = f"greatest(draw - {WIDER_AFTER - 1}, 0)"  # digits or letters that a late draw adds
    rows = rows.withColumn("digits", F.expr(f"substring(translate(substring(noise, 901), 'abcdef', '123456'), 1, {more})"))
    rows = rows.withColumn("letters", F.expr("translate(digits, '0123456789', 'aeioulnrst')")).withColumn("endings", F.expr("translate(digits, '0123456789', 'аеиоулнрст')"))
    octet = lambda k: f"CAST(CASE WHEN {more} > 0 THEN 1 + {_byte(str(k))} % 254 ELSE CASE length(split(canon, '[.]')[{k}]) WHEN 1 THEN 1 + {_byte(str(k))} % 9 WHEN 2 THEN 10 + {_byte(str(k))} % 90 ELSE 100 + {_byte(str(k))} % 155 END END AS STRING)"
    ip = "concat_ws('.', " + ", ".join(octet(k) for k in range(4)) + ")"
    rows = rows.withColumn("head", F.expr("CASE WHEN kind = 'card' THEN concat(substring(canon, 1, 1), substring(mapped, 2, length(canon) - 2), digits) END"))
    card = f"concat(head, CAST(pmod({_luhn('canon')} - {_luhn('concat(head, 0)')}, 10) AS STRING))"
    local = "substring_index(mapped, '/', -1)"
    phone = f"concat(substring_index(canon, '/', 1), '/', IF(substring({local}, 1, 1) = '0', '2', substring({local}, 1, 1)), substring({local}, 2), digits)"
    email = "concat(regexp_replace(mapped, '[.][^.]*$', ''), digits, '.example')"
    iban = "concat(substring(canon, 1, 2), substring(mapped, 3), digits)"
    secret = "concat(mapped, IF(hex, digits, letters))"
    given = "CASE kind" + "".join(f" WHEN '{kind}' THEN IF({more} > 0, concat(mapped, {'endings' if 'cyrillic' in kind else 'letters'}), array({', '.join(repr(x.lower()) for x in names)})[{_byte('252')} % {len(names)}])" for kind, names in GIVEN.items())
    made = f"CASE kind WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} WHEN 'phone' THEN {phone} WHEN 'email' THEN {email} WHEN 'iban' THEN {iban} WHEN 'ssn' THEN concat(mapped, digits) WHEN 'secret' THEN {secret} ELSE {given} WHEN 'surname cyrillic' THEN concat(mapped, endings) ELSE concat(mapped, letters) END END"
    return rows.select("kind", "canon", F.expr(made).alias("made"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, n, made) of distinct entities of rows (kind, canon), n times there: made is unique in its kind and no entity itself."""
    spark = entities.sparkSession
    known, _ = written(entities.where("kind IS NOT NULL").groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("n")), "pii-entities")
    taken = known.select("kind", F.col("canon").alias("made"))
    open_rows, open_at, done = known.select("kind", "canon"), None, None
    for draw in range(DRAWS):
        drawn, drawn_at = written(_drawn(open_rows.withColumn("draw", F.lit(draw)), key), "pii-drawn")
        first = drawn.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
        good, _ = written(first.join(taken, ["kind", "made"], "left_anti").select("kind", "canon", "made"), "pii-good")
        done = good if done is None else done.union(good)
        taken = taken.union(good.select("kind", "made"))
        left, left_at = written(drawn.select("kind", "canon").join(good, ["kind", "canon"], "left_anti"), "pii-open")
        release(spark, drawn_at, *([open_at] if open_at else []))
        open_rows, open_at = left, left_at
        if open_rows.isEmpty():
            return known.join(done, ["kind", "canon"]).select("kind", "canon", "n", "made")
    raise ValueError(f"entities whose surrogates still collide after {DRAWS} draws")


def _told(found: DataFrame, made: DataFrame) -> DataFrame:
    """found with made. Entities that are more than a share of all rows are joined by broadcast: there are fewer than HOT_SHARE."""
    columns = ("uid", "place", "nth", "fixed", "part", "kind", "made")
    total = made.agg(F.sum("n")).first()[0] or 0
    hot = made.where(F.col("n") * HOT_SHARE > total).select("kind", "canon", "made")
    rest = made.where(F.col("n") * HOT_SHARE <= total).select("kind", "canon", "made")
    marked = found.join(F.broadcast(hot.withColumnRenamed("made", "hot_made")), ["kind", "canon"], "left")
    often = marked.where("hot_made IS NOT NULL OR kind IS NULL").withColumn("made", F.col("hot_made"))
    seldom = marked.where("hot_made IS NULL AND kind IS NOT NULL").join(rest, ["kind", "canon"])
    return often.select(*columns).union(seldom.select(*columns))


def _laid_out() -> str:
    """The surrogate in the layout of one spelling."""
    kept = "length(regexp_replace(part, '[^0-9A-Za-z]', ''))"
    fill = lambda made: f"concat(array_join(transform(split(part, ''), (c, i) -> IF(c RLIKE '^[0-9A-Za-z]$', substring({made}, length(regexp_replace(substring(part, 1, i + 1), '[^0-9A-Za-z]', '')), 1), c)), ''), substring({made}, {kept} + 1))"
    cased = "CASE WHEN part = upper(part) AND part <> lower(part) AND length(part) > 1 THEN upper(made) WHEN part RLIKE '^\\\\p{Lu}' THEN concat(upper(substring(made, 1, 1)), substring(made, 2)) ELSE made END"
    return f"concat(fixed, CASE WHEN kind IS NULL THEN part WHEN kind IN ('card', 'ssn') THEN {fill('made')} WHEN kind = 'phone' THEN {fill(chr(40) + 'substring_index(made, ' + repr('/') + ', -1)' + chr(41))} WHEN kind = 'iban' THEN {fill('substring(made, 3)')} WHEN kind IN ('ip', 'secret') THEN made ELSE {cased} END)"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with entities in text replaced under a key; all columns kept."""
    names = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{x}`") for x in names)).alias("row"))
    has = F.coalesce(F.col("row.text").rlike(LIKELY) & F.col("row.text").rlike(ANY), F.lit(False))
    all_of = lambda pattern: F.regexp_extract_all("row.text", F.lit(pattern), F.lit(0))
    hits = inner.where(has).select(F.monotonically_increasing_id().alias("uid"), "row", all_of(ANY).alias("first"))
    hits = hits.withColumn("named", F.exists("first", lambda x: x.rlike(f"^(?:{PATTERNS['called']}|{PATTERNS['named']})$")))
    hits = hits.withColumn("raws", F.when(F.col("named"), all_of(ANY_OR_WORD)).otherwise(F.col("first")))
    hits, _ = written(hits.withColumn("first", F.when(F.col("named"), F.col("first"))), "pii-rows")
    # names of the plain pattern count too: a capital word in front may have hidden them from the wider one
    rows = hits.select("uid", F.posexplode("raws").alias("place", "raw")).union(hits.where("named").select("uid", F.lit(-1).alias("place"), F.explode("first").alias("raw")))
    digits = "regexp_replace(raw, '[^0-9]', '')"
    card = F.expr(f"CASE WHEN found = 'card' THEN {_luhn(digits)} % 10 = 0 ELSE true END")  # other runs of figures are no cards
    rows, rows_at = written(_described(rows).where(card & ((F.col("place") >= 0) | F.col("found").isin("called", "named"))), "pii-raws")
    found = _entities(rows)
    release(docs.sparkSession, rows_at)
    told = _told(found, surrogates(found, key)).select("uid", "place", "nth", F.expr(_laid_out()).alias("new"))
    told = told.groupBy("uid", "place").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(nth, new))), x -> x.new)"), " ").alias("new"))
    told = told.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("place", "new"))).alias("new"))
    replaced = hits.join(told, "uid", "left").withColumn("parts", F.when(F.col("named"), F.split("row.text", ANY_OR_WORD, -1)).otherwise(F.split("row.text", ANY, -1)))
    text = F.expr("array_join(transform(parts, (x, i) -> concat(x, coalesce(try_element_at(new, i), get(raws, i), ''))), '')")
    replaced = replaced.withColumn("text", text).select(*(F.col("text").alias(x) if x == "text" else F.col(f"row.`{x}`").alias(x) for x in names))
    clean = inner.where(~has).select(*(F.col(f"row.`{x}`").alias(x) for x in names))
    return clean.union(replaced)


def op10(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32))
