"""A table kept up by key, against a dictionary."""

import os
import random

from pyspark.sql import functions as F

from tidewell.operators.key_table import KeyTable

SCHEMA = "unique_id string, value long, at long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_inserts_changes_and_deletes(spark, tmp_path):
    rng = random.Random(3)
    table, want = KeyTable(spark, str(tmp_path / "t"), SCHEMA, buckets=3, slots=4), {}
    for turn in range(4):
        rows = [(f"k{rng.randrange(60)}" if i else None, rng.randrange(1000), turn * 100 + i) for i in range(40)]
        table.insert_new(frame(spark, rows), ["at"])
        for key, value, at in rows:
            if key:
                want.setdefault(key, (value, at))
        rows = [(f"k{rng.randrange(80)}", rng.randrange(1000), turn * 100 + 50 - i) for i in range(9)]
        table.upsert(frame(spark, rows), ["at"])
        for key, value, at in rows:
            if key not in want or at > want[key][1]:
                want[key] = (value, at)
        gone = [f"k{rng.randrange(60)}" for _ in range(4)] + ([None] if turn == 2 else [])
        table.delete(spark.createDataFrame([(k,) for k in gone], "unique_id string"))
        for key in gone:
            want.pop(key, None)
        got = {r.unique_id: (r.value, r.at) for r in KeyTable(spark, str(tmp_path / "t"), SCHEMA, buckets=3, slots=4).rows().collect()}
        assert got == want
    table.delete(table.rows())
    assert table.rows().count() == 0


def test_the_stored_side_is_not_shuffled(spark, tmp_path):
    table = KeyTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4, slots=2)
    table.insert_new(spark.range(1000).selectExpr("concat('k', id) AS unique_id", "id AS value", "id AS at"), ["at"])
    rows = spark.range(900, 1100).selectExpr("concat('k', id) AS unique_id", "id AS value", "id AS at")
    found = table.unseen(rows)
    assert found.count() == 100
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scan = next(i for i, line in enumerate(final.splitlines()) if table.name in line)
    above = []
    depth = final.splitlines()[scan].index("FileScan")
    for line in reversed(final.splitlines()[:scan]):  # the operators between the join and the scan
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if at < depth:
            above.append(line)
            depth = at
        if "Join" in line:
            break
    assert "Join" in above[-1] and not [x for x in above if "Exchange" in x], final
    assert "Bucketed: true" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_only_touched_slots_are_rewritten(spark, tmp_path):
    table = KeyTable(spark, str(tmp_path / "t"), SCHEMA, buckets=2, slots=8)
    table.insert_new(spark.range(500).selectExpr("concat('k', id) AS unique_id", "id AS value", "id AS at"), ["at"])
    files = lambda: {(d, f) for d, _, names in os.walk(tmp_path / "t" / "rows") for f in names if f.endswith(".parquet")}
    before = files()
    table.upsert(frame(spark, [("k7", -1, 10_000)]), ["at"])
    after = files()
    changed = {d for d, _ in before ^ after}
    assert len(changed) == 1 and len({d for d, _ in after}) == 8
    assert table.rows().where("unique_id = 'k7'").first().value == -1 and table.rows().count() == 500


def test_a_change_that_broke_off_is_put_in_place(spark, tmp_path, monkeypatch):
    table = KeyTable(spark, str(tmp_path / "t"), SCHEMA, buckets=2, slots=4)
    table.insert_new(frame(spark, [("a", 1, 1), ("b", 1, 1)]), ["at"])
    monkeypatch.setattr(KeyTable, "recover", lambda self: None)
    table.upsert(frame(spark, [("a", 2, 2)]), ["at"])  # ends before the rows are put in place
    assert {r.unique_id: r.value for r in table.rows().collect()} == {"a": 1, "b": 1}
    monkeypatch.undo()
    again = KeyTable(spark, str(tmp_path / "t"), SCHEMA, buckets=2, slots=4)
    assert {r.unique_id: r.value for r in again.rows().collect()} == {"a": 2, "b": 1}


def test_keys_that_do_not_count(spark, tmp_path):
    table = KeyTable(spark, str(tmp_path / "t"), SCHEMA, buckets=2, slots=2)
    table.append(frame(spark, [("a", 1, 1), ("b", 1, 2)]))
    asked = frame(spark, [("a", 0, 0), ("b", 0, 0), ("c", 0, 0)])
    assert sorted(r.unique_id for r in table.unseen(asked, F.col("at") == 2).collect()) == ["b", "c"]
