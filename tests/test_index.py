"""The automaton against plain patterns, and the word index against a scan."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell import fixtures, versions
from tidewell.functions import automaton, classify, lexicons
from tidewell.operators import filters, search_index

LISTS = classify.every_list()
ALL = tuple(dict.fromkeys([*(p for own in LISTS for p in own), r"\d{4}", r"(?:a|b)+c?", r"x*", r"[^a-z]q", r"stra(ß|ss)e", r"(?:un)?tied|knot{2}"]))
OWN = automaton.Patterns(ALL)
WORDS = ["request for", "Request  for", "proposals", "bidding", "grants", "call", "for applications (consultants)", "m & e", "RFP", "rfps", "mid-line", "midterm review", "pre-feasibility", "training of", "roll-out", "MEL", "camel", "straße", "STRASSE", "unTied", "knott", "2024", "ſolicitation", "mıdline", "İtb", "smallholder", "data\ncollection", "", "health", "wealthy"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=8), st.sampled_from([" ", "", "-", "\t"]))
def test_patterns_held(words, between):
    text = between.join(words)
    assert sorted(OWN.held(text)) == [i for i, p in enumerate(ALL) if text and re.search(p, text, re.IGNORECASE)]


def test_literals():
    assert automaton.literals(r"\bbid(s|ding)?\b") == {"bid"} and automaton.literals(r"conference|workshop") == {"conference", "workshop"}
    assert automaton.literals(r"\d+") is None and automaton.literals(r"(?:ab)?c*") is None
    assert sum(automaton.literals(p) is None for own in LISTS for p in own) == 0


def test_counts_as_by_single_patterns(spark):
    rows = [(i, " ".join(WORDS[i % 7 : i % 7 + 4]) or None, None if i % 5 == 0 else " ".join(WORDS[i % 11 :])) for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r.id: r.n for r in frame.select("id", automaton.counted([*LISTS, []], F.col("a"), F.col("b")).alias("n")).collect()}
    for i, a, b in rows:
        assert got[i] == [[sum(bool(re.search(p, t or "", re.IGNORECASE)) for p in own) if t else 0 for own in [*LISTS, []]] for t in (a, b)]
    for few in (0, 24):
        held = frame.select("id", automaton.any_terms_held(spark.createDataFrame([("for",), ("fo",), ("bid",), ("",), ("for",)], "t string"), F.lower("a"), F.lower("b"), block=2, few=few).alias("n"))
        assert {r.id: set(r.n or []) for r in held.collect()} == {i: {t for t in ("for", "fo", "bid") if t in (a or "").lower() or t in (b or "").lower()} for i, a, b in rows}


def test_a_lexicon_from_a_table(spark):
    rows = spark.createDataFrame([("B", 2, r"\bbolt"), ("A", 1, "ring"), ("B", 1, "nut")], "label string, place int, pattern string")
    lexicon = lexicons.read(rows)
    assert lexicon == {"A": ["ring"], "B": ["nut", r"\bbolt"]}
    frame = spark.createDataFrame([("A ring with nuts",), ("bolts",), ("thunderbolt",)], "t string")
    assert [r[0] for r in frame.select(classify.verticals(F.col("t"), F.lit(""), lexicon)).collect()] == [["A", "B"], ["B"], []]


@pytest.fixture(scope="module")
def opps(spark, sf_dir):
    at = fixtures.scratch(spark, "test-listings")
    fixtures.opportunities(spark, sf_dir).write.parquet(at)
    return spark.read.parquet(at)


def test_index_after_inserts_changes_and_deletes(spark, opps):
    at = fixtures.scratch(spark, "test-index")
    now = opps.where("id % 10 = 0")
    search_index.add_batch(at, 1, now)
    for batch in range(2, 9):  # each adds a tenth, renames some of what is there and drops some
        new = opps.where(F.col("id") % 10 == batch)
        changed = now.where(F.col("id") % 13 == batch).withColumn("title", F.concat(F.lit(f"Zebra{batch} "), "title"))
        gone = now.where((F.col("id") % 13 != batch) & (F.col("id") % 17 == batch))
        search_index.add_batch(at, batch, new.unionByName(changed), gone)
        now = now.where((F.col("id") % 13 != batch) & (F.col("id") % 17 != batch)).unionByName(changed).unionByName(new)
        stored = fixtures.scratch(spark, "test-now")
        now.write.parquet(stored)
        now = spark.read.parquet(stored)
        search_index.add_batch(at, batch, opps)  # again, which changes nothing
    version, state = versions.newest(spark, f"{at}/versions")
    assert version == 8 and state["batch"] == 8 and len(state["segments"]) < 8
    assert search_index.stray(now, at).count() == 0
    for text in ("zebra3", "Zeb rin", "ste stud", "bolt nothere", "gra-pro", "--", '"ring'):
        found = lambda frame: sorted(r.id for r in frame.select("id").collect())
        assert found(search_index.searched(now, at, text)) == found(now.where(filters.search(text))), text
    search_index.merge(spark, at)
    search_index.vacuum(spark, at)
    assert len(versions.names(spark, f"{at}/segments")) == 1 and not versions.names(spark, f"{at}/gone")
    assert sorted(r.id for r in search_index.searched(now, at, "zebra5").collect()) == sorted(r.id for r in now.where(filters.search("zebra5")).collect())


def test_a_search_reads_its_range_of_words(spark, opps):
    at = fixtures.scratch(spark, "test-index")
    search_index.add_batch(at, 1, opps)
    plan = search_index.candidates(spark, at, "bol")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(word,bol)" in plan and "LessThanOrEqual(word,bol" in plan
    assert search_index.candidates(spark, at, "bol").count() > 0


def test_bitmaps_hold_their_ids(spark):
    ids = [0, 1, 7, 8, 32_767, 32_768, 65_535, 10**12, -1, -40_000]
    bits = search_index.bitmaps(spark.createDataFrame([(i,) for i in ids], "id long"))
    asked = spark.createDataFrame([(i + d,) for i in ids for d in (-2, -1, 0, 1, 2)], "id long").distinct()
    met = asked.withColumn("bucket", F.bitmap_bucket_number("id")).join(bits, "bucket", "left")
    got = met.where(search_index._in("bits", "id")).select("id").collect()
    assert sorted(r.id for r in got) == sorted(ids)


def test_one_writer_wins_a_version(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert versions.newest(spark, folder) == (0, {})
    assert versions.put(spark, folder, 1, {"a": "é" * 100_000}) and not versions.put(spark, folder, 1, {"a": 2})
    assert versions.newest(spark, folder) == (1, {"a": "é" * 100_000}) and len(versions.names(spark, folder)) == 1
