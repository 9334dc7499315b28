"""Very many terms, looked for by a join: the same as one automaton finds."""

import random

from pyspark.sql import functions as F

from tidewell.functions import automaton, grams


def test_a_join_finds_what_an_automaton_finds(spark, monkeypatch):
    monkeypatch.setattr(grams, "ROWS", 7)
    chance = random.Random(3)
    word = lambda n: "".join(chance.choice("abé𝄞 #0") for _ in range(n))
    texts = [(i, None if i % 11 == 0 else "" if i % 7 == 0 else word(chance.randrange(60)), word(chance.randrange(20))) for i in range(120)]
    pieces = [t[a : a + n] for _, t, _ in texts if t for n in (1, 2, 3, 5, 15, 16, 17, 33, 40) for a in [chance.randrange(len(t))]]
    terms = sorted({x for x in [*pieces, *(word(n) for n in range(1, 40)), "", "customer#000000017", "not there at all"]})
    rows = spark.createDataFrame(texts, "id long, a string, b string").repartition(3)
    frame = spark.createDataFrame([(x,) for x in terms for _ in range(2)], "term string")
    got = {r.id: r.held for r in grams.with_terms(rows, "held", frame, F.col("a"), F.col("b"), block=20).collect()}
    assert got == {i: sorted(t for t in terms if t and (t in (a or "") or t in b)) for i, a, b in texts}
    few = {r.id: sorted(r.held) for r in grams.with_terms(rows, "held", terms, F.col("a"), F.col("b"), block=5000).collect()}
    assert few == got and any(got.values())


def test_very_many_terms_do_not_meet_in_a_task(spark, monkeypatch):
    """No list of terms is sent out: what goes to every task is a filter of a few bytes a term."""
    from tidewell.config import AS_OF
    from tidewell.operators import routing

    sent = []
    own = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or own(self, value))
    people = spark.range(2000).selectExpr("id AS member_id", "concat('firm ', id, ', no such ', id) AS keywords", "'' AS categories", "'' AS verticals")
    opps = spark.range(300).selectExpr("id", "'a call' AS title", "concat('Firm ', id * 7) AS organization", "'' AS summary", "'' AS vertical", "'' AS verticals", "'Grant' AS category", "'Active' AS status", "CAST(NULL AS DATE) AS deadline", "true AS approved", "id AS date_scraped")
    found = sorted((r.member_id, r.id) for r in routing.matches(opps, people, AS_OF, block=100).select("member_id", "id").collect())
    assert found == sorted((m, i) for i in range(300) for m in range(2000) if f"firm {m}" in f"firm {i * 7}")
    assert sent and not any(isinstance(x, list) and len(x) > 100 for x in sent) and max(len(x) for x in sent) <= 4 * 4000
