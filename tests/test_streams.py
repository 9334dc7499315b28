"""Streams over tables of their own: page batches in any order, few files, what a batch costs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.catalog import ORACLES, QUERIES
from tidewell.config import AS_OF
from tidewell.plans import ingest as plan
from tidewell.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def alike(spark, sf_dir, tmp_path_factory):
    """The smallest tables with every listing a second time under a later id and another category."""
    at = str(tmp_path_factory.mktemp("alike"))
    later = 990 * 1000  # ids that leave the same rests give the same titles
    for name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "orders":
            rows = rows.union(rows.withColumn("o_orderkey", F.col("o_orderkey") + later).withColumn("o_orderpriority", F.translate("o_orderpriority", "12345", "23451")).withColumn("o_orderpriority", F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))), F.substring("o_orderpriority", 1, 1).cast("int"))))
        if name == "lineitem":
            rows = rows.union(rows.withColumn("l_orderkey", F.col("l_orderkey") + later))
        rows.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def answer(at: str, name: str) -> list[tuple]:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    return sorted(connection.execute(ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", ["str_01_page_batches", "str_06_after_batch"])
def test_the_first_of_alike_listings_counts_whatever_batch_comes_first(spark, alike, name):
    assert sorted(map(tuple, QUERIES[name](spark, alike).collect())) == answer(alike, name)


def test_a_batch_of_one_file_is_worked_on_by_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(100).selectExpr("id", "concat('t', id) AS title").coalesce(1)
    assert ingest.dealt(rows).rdd.getNumPartitions() >= cores and sorted(r.id for r in ingest.dealt(rows).collect()) == list(range(100))
    assert ingest.dealt(rows.repartition(5 * cores)).rdd.getNumPartitions() == 5 * cores


def test_only_what_is_new_is_classified(spark):
    """The rows are those of the whole chain; texts of rows that are over, known or come twice reach no classifier."""
    columns = [c.split()[0] for c in plan.RAW.split(", ")]
    listed = [(n, f"Water grant {n % 40}", "Open" if n % 3 else "1 May 1990", f"for health {n}") for n in range(120)]
    raw = spark.createDataFrame([(i, *(title if c == "title" else deadline if c == "deadline_raw" else summary if c == "summary" else c in ("dayfirst", "assume_active") if c in ("dayfirst", "assume_active") else "x" for c in columns)) for i, title, deadline, summary in listed], f"id long, {plan.RAW}")
    known = plan.dated(raw.where("id < 30"), plan.Rules(AS_OF)).select("unique_id")
    for rules in (plan.Rules(AS_OF), plan.Rules(AS_OF, wanted_verticals=["Health"])):
        unseen = lambda rows: rows.join(known, "unique_id", "left_anti")
        whole = plan.only_new(plan.accepted(plan.judged(raw, rules), rules), known, ["id"])
        fresh = plan.fresh(raw, rules, ["id"], unseen)
        assert set(fresh.columns) == set(whole.columns)
        rows = lambda frame: sorted(map(repr, frame.select(sorted(whole.columns)).collect()))
        assert rows(fresh) == rows(whole) and len(rows(whole)) == fresh.select("title").distinct().count()
    lines = plan.fresh(raw, plan.Rules(AS_OF), ["id"], unseen)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    classified = [n for n, line in enumerate(lines) if "EvalPython" in line and "array<array<int>>" in line or "EvalPython" in line and "run(" in line]
    joined = next(n for n, line in enumerate(lines) if "Join LeftAnti" in line)
    assert classified and min(classified) < joined  # above the join: only what it leaves


def test_saved_pages_are_found_again(spark, tmp_path):
    """Each page as one file where the crawl looks for it, read once from its rows; a page that is written again is replaced."""
    from tidewell.sources import paged

    bodies = spark.range(30).selectExpr("concat('s', id % 3) AS source", "CAST(id div 3 + 1 AS INT) AS page", "concat('[', id, ' é]') AS body")
    for _ in range(2):
        assert paged.save(bodies, f"file://{tmp_path}/saved").count() == 30
    fetch = paged.tree(f"file://{tmp_path}/saved")
    assert [fetch(f"https://example.org/list?source=s{i % 3}&page={i // 3 + 1}") for i in range(30)] == [(200, f"[{i} é]") for i in range(30)]
    assert fetch("https://example.org/list?source=s0&page=11")[0] == 404


def test_figures_of_batches_are_all_stored_and_logs_are_put_in_place_plainly(spark, tmp_path):
    from tidewell.shared import MANAGER, PLAIN, plain_log
    from tidewell.streaming import watch

    seen = []
    with watch.recorded(spark, f"{tmp_path}/figures"), plain_log(spark, str(tmp_path)):
        assert spark.conf.get(MANAGER) == PLAIN
        query = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 3).load().writeStream.foreachBatch(lambda rows, batch_id: seen.append(rows.count())).option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="0 seconds").start()
        while len(seen) < 40 and query.isActive:
            query.awaitTermination(0.1)
        query.stop()
    assert spark.conf.get(MANAGER, None) is None
    told = {r.batch: r.rows for r in watch.batches(spark, f"{tmp_path}/figures").collect()}
    assert len(told) >= 39 and set(told) >= set(range(39)) and set(told.values()) == {3}


def test_a_bounded_batch_costs_one_job_and_no_file(spark, sf_dir, tmp_path, monkeypatch):
    from tidewell.catalog import streams

    folders = iter(range(9))
    monkeypatch.setattr(streams, "_folder", lambda spark: f"{tmp_path}/{next(folders)}")
    found = streams.bounded_batches(spark, sf_dir).first()
    assert found.bounded and found.several and found.rows_in == spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert not list(tmp_path.rglob("*.parquet")) and len(list(tmp_path.glob("*/checkpoint/commits/[0-9]*"))) == 3  # 20 pages


def test_a_crawl_that_is_paused_goes_on_and_keeps_no_marks(spark, sf_dir, tmp_path, monkeypatch):
    from tidewell.catalog import streams

    folders = iter(range(9))
    monkeypatch.setattr(streams, "_folder", lambda spark: f"{tmp_path}/{next(folders)}")
    rows = {r.source: r.n for r in streams.pause_and_resume(spark, sf_dir).collect()}
    assert len(rows) == 4 and "BUILDING" not in rows
    assert list(tmp_path.glob("*/out/batch=*/*.parquet")) and not list(tmp_path.glob("*/out/batch=*/_SUCCESS"))


def test_progress_notes_every_batch_once(spark, sf_dir, tmp_path, monkeypatch):
    from tidewell.catalog import streams

    folders = iter(range(9))
    monkeypatch.setattr(streams, "_folder", lambda spark: f"{tmp_path}/{next(folders)}")
    found = streams.progress(spark, sf_dir).first()
    assert found.bounded and found.pages == len(list(tmp_path.glob("*/saved/source=*/page=*/body")))
    assert len(list(tmp_path.glob("*/progress/*/*.json"))) >= len(list(tmp_path.glob("*/out/batch=*"))) > 1 and not list(tmp_path.glob("*/out/batch=*/_SUCCESS"))
