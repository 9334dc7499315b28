"""Sources over a server of their own: limits a batch, restarts, ends, pushed filters, posted forms."""

import datetime
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

import pytest
from pyspark.sql import functions as F

from tidewell.sources import items, paged
from tidewell.streaming import crawl


@pytest.fixture
def server():
    """A server that answers as its ``answer(path, query, posted)`` says, and keeps what it was asked."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, posted=None):
            at = urlsplit(self.path)
            query = parse_qsl(at.query)
            self.server.asked.append((at.path, tuple(query)))
            body = self.server.answer(at.path, dict(query), posted, query)
            self.send_response(200 if body is not None else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def do_GET(self):
            self._reply()

        def do_POST(self):
            self._reply(dict(parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode())))

        def log_message(self, *args):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    own.asked, own.at = [], f"http://127.0.0.1:{own.server_port}"
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield own
    own.shutdown()
    own.server_close()


def test_a_batch_reads_no_more_pages_than_it_may_and_a_restart_none_twice(spark, server, tmp_path):
    ends = {"/a": 7, "/b": 30, "/c": 4}
    server.answer = lambda path, query, *_: f"{path} {query['page']}" if int(query["page"]) <= ends[path] else ""
    spark.dataSource.register(paged.PagedSource)
    options = {"sources": json.dumps({x[1:]: f"{server.at}{x}?page={{page}}" for x in ends}), "pages": "25", "pages_per_batch": "6", "pages_per_partition": "2", "marks": str(tmp_path / "marks"), "checkpoint": str(tmp_path / "checkpoint"), "retries": "1"}
    sizes = []

    def batch(rows, batch_id):
        sizes.append(rows.count())
        rows.select("source", "page", "body").write.mode("overwrite").json(f"{tmp_path}/out/batch={batch_id}")

    def run(pages):
        query = spark.readStream.format("paged").options(**options | {"pages": str(pages)}).load().writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    run(5)  # as far as five pages of each, then stopped and taken up again
    seen = len(server.asked)
    assert len(sizes) > 2 and sum(sizes) == 14 and max(sizes) <= 6
    run(25)
    assert max(sizes) <= 6 and len(server.asked) > seen
    rows = sorted((r.source, r.page, r.body) for r in spark.read.schema("source string, page int, body string").json(f"{tmp_path}/out").collect())
    assert rows == sorted((x[1:], n, f"{x} {n}") for x, last in ends.items() for n in range(1, min(last, 25) + 1))
    pages = [(path, int(dict(query)["page"])) for path, query in server.asked]
    # a page is asked for once for the count and once for the files of its batch, never in two batches
    assert all(pages.count(p) <= 2 for p in set(pages))
    for path, last in ends.items():
        assert len({n for p, n in pages if p == path and n > last}) <= 3  # one for each partition of the batch in which the source ends
    assert paged.Marks(str(tmp_path / "marks")).ended() == {"a": 8, "c": 5}


def test_an_offset_is_taken_from_the_log(tmp_path):
    (tmp_path / "offsets").mkdir()
    for n in (3, 20):
        (tmp_path / "offsets" / str(n)).write_text(f'v1\n{{"batchWatermarkMs":0}}\n{{"a": {n}, "b": 2}}')
    reader = paged.PagedStream({"sources": '{"a": "u", "b": "v", "c": "w"}', "pages": "40", "pages_per_batch": "5", "checkpoint": f"file://{tmp_path}"})
    assert reader.latestOffset() == {"a": 22, "b": 4, "c": 1}
    parts = reader.partitions({"a": 20, "b": 2}, {"a": 21, "b": 4, "c": 2})
    assert [(p.source, p.first, p.last) for p in parts] == [("a", 21, 21), ("b", 3, 4), ("c", 1, 2)]
    assert reader.latestOffset() == {"a": 23, "b": 6, "c": 3}


def test_state_ends_a_crawl(spark, server, tmp_path):
    """One source repeats itself, one goes on with nothing new, one is empty at its end, one goes on."""

    def answer(path, query, *_):
        n = int(query["page"])
        listed = {"/repeats": [f"r{(n - 1) % 5}x", f"r{(n - 1) % 5}y"], "/stale": [f"s{min(n, 3)}", f"t{n % 2}" if n < 3 else "s1"], "/short": [f"e{n}"] if n < 4 else [], "/long": [f"l{n}"]}[path]
        return json.dumps(listed + ([f"only {n}"] if path == "/stale" and n < 3 else []))

    server.answer = answer
    spark.dataSource.register(paged.PagedSource)
    names = ["repeats", "stale", "short", "long"]
    marks, checkpoint = str(tmp_path / "marks"), str(tmp_path / "checkpoint")
    options = {"sources": json.dumps({x: f"{server.at}/{x}?page={{page}}" for x in names}), "pages": "20", "pages_per_batch": "8", "pages_per_partition": "2", "marks": marks, "checkpoint": checkpoint, "retries": "1"}
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        pages = spark.readStream.format("paged").options(**options).load().withColumn("items", F.from_json("body", "array<string>"))
        query = crawl.guarded(pages, 3, marks).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    out = spark.read.schema(crawl.OUT).json(f"{tmp_path}/out")
    last = {r.source: r.page for r in out.where("item IS NOT NULL").groupBy("source").agg(F.max("page").alias("page")).collect()}
    assert last == {"repeats": 5, "stale": 3, "short": 3, "long": 20}
    assert sorted(r.item for r in out.where("is_new AND source = 'repeats'").collect()) == sorted(f"r{i}{c}" for i in range(5) for c in "xy")
    assert paged.Marks(marks).ended().keys() == {"repeats", "stale", "short"}
    for name in ("repeats", "stale", "short"):  # at most what the batch of the end had been given beyond it
        assert max(int(dict(q)["page"]) for p, q in server.asked if p == f"/{name}") <= last[name] + 4


ROWS = [{"id": i, "title": f"call {i}", "category": "ABC"[i % 3], "deadline": f"2026-{i % 12 + 1:02d}-10", "price": i / 4} for i in range(300)]


def test_filters_go_to_the_source(spark, server):
    def answer(path, query, posted, pairs):
        wanted = [v for k, v in pairs if k == "sectors"]
        found = [r for r in ROWS if (not wanted or r["category"] in wanted) and query.get("after", "0") <= r["deadline"] <= query.get("before", "9")]
        n = int(query["page"])
        return json.dumps({"meta": {"total": len(found)}, "rows": found[(n - 1) * 20 : n * 20]})

    server.answer = answer
    spark.dataSource.register(items.ItemSource)
    options = {"template": f"{server.at}/calls?page={{page}}", "page_size": "20", "pages_per_partition": "3", "total": "meta.total", "parameters": json.dumps({"category": "sectors", "deadline": {"from": "after", "to": "before"}}), "retries": "1"}
    calls = spark.read.format("items").schema("id long, title string, category string, deadline date, price double").options(**options)
    day = lambda n: F.lit(datetime.date(2026, n, 10))
    cases = [
        (F.col("category") == "A", lambda r: r["category"] == "A", 100),
        (F.col("category").isin("A", "C") & (F.col("price") > 20), lambda r: r["category"] in "AC" and r["price"] > 20, 200),
        ((F.col("category") == "B") & (F.col("deadline") >= day(3)) & (F.col("deadline") <= day(5)), lambda r: r["category"] == "B" and "2026-03-10" <= r["deadline"] <= "2026-05-10", 25),
        ((F.col("deadline") > day(3)) & F.col("title").like("%7"), lambda r: r["deadline"] > "2026-03-10" and r["title"].endswith("7"), 300),
        ((F.col("category") == "A") & (F.col("category") == "B"), lambda r: False, 100),
    ]
    name = "spark.sql.python.filterPushdown.enabled"
    for test, keeps, reached in cases:
        spark.conf.set(name, "true")
        try:
            server.asked.clear()
            frame = calls.load().where(test)
            got = sorted(r.id for r in frame.collect())
            pages = {q for _, q in server.asked}
            plan = frame._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset(name)
        assert got == [r["id"] for r in ROWS if keeps(r)]
        assert len(pages) <= max(1, -(-reached // 20)), (len(pages), reached)
        if reached < 300 and got:  # Spark keeps no test that the source makes
            assert not [line for line in plan.splitlines() if "Filter" in line and ("= A" in line or "= B" in line or "IN (A" in line or ">= " in line)]


def test_a_source_without_parameters_leaves_all_to_spark(spark, server):
    server.answer = lambda path, query, *_: json.dumps(ROWS[(int(query["page"]) - 1) * 50 : int(query["page"]) * 50])
    spark.dataSource.register(items.ItemSource)
    calls = spark.read.format("items").schema("id int, category string").options(template=f"{server.at}/all?page={{page}}", pages="9", pages_per_partition="2", retries="1")
    assert sorted(r.id for r in calls.load().where("category = 'B'").collect()) == [r["id"] for r in ROWS if r["category"] == "B"]
    assert len(server.asked) <= 6 + 2  # each partition beyond the end asks once


def test_pages_are_turned_by_posting_the_form(spark, server):
    """A board whose every page comes by the hidden fields of the one before."""

    def answer(path, query, sent, *_):
        page = 1 if sent is None else int(sent["__EVENTARGUMENT"].removeprefix("Page$"))
        if sent is not None and (sent["__VIEWSTATE"] != f"state {page - 1} & so on" or sent["__EVENTTARGET"] != "grid"):
            return None
        later = "".join(f"<a href=\"javascript:__doPostBack('grid','Page${n}')\">{n}</a>" for n in range(1, 5) if n != page)
        return f"<form><input type='hidden' name='__VIEWSTATE' value='state {page} &amp; so on' /><input type=\"hidden\" name=\"kept\" value=\"\"></form><h2>page {page}</h2>{later}"

    server.answer = answer
    spark.dataSource.register(paged.PagedSource)
    rows = spark.read.format("paged").options(template=f"{server.at}/board", pages="9", form="true", retries="1", source="board").load().collect()
    assert [(r.page, f"<h2>page {r.page}</h2>" in r.body) for r in rows] == [(n, True) for n in range(1, 5)]
    assert len(server.asked) == 4
    assert paged.form_fields(rows[0].body) == {"__VIEWSTATE": "state 1 & so on", "kept": ""} and paged.posted("u", rows[0].body, 9) is None


def test_a_foreign_scan_makes_our_tests(spark, tmp_path):
    from tidewell.sources import foreign

    spark.range(100).selectExpr("id AS no", "concat('k', id % 3) AS kind", "'01/02/2026' AS closes").write.parquet(str(tmp_path / "f"))
    ours = foreign.mapped(spark.read.parquet(str(tmp_path / "f")), {"id": "no", "category": "kind", "deadline": F.to_date("closes", "dd/MM/yyyy")}, ["id", "title", "category", "deadline"])
    found = ours.where("category = 'k1' AND id > 50 AND deadline = DATE '2026-02-01'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,k1)" in plan and "GreaterThan(no,50)" in plan
    assert [tuple(r) for r in found.orderBy("id").limit(1).collect()] == [(52, None, "k1", datetime.date(2026, 2, 1))]
    with pytest.raises(ValueError):
        foreign.mapped(ours, {"nope": "id"}, ["id"])


def test_ranges_hold_no_more_than_a_source_shows(spark):
    """A skewed axis with a value that many share, and one of a single value."""
    skewed = spark.range(20_000).selectExpr("CASE WHEN id % 4 = 0 THEN 7.0D WHEN id % 4 = 1 THEN pow(10, id % 50 - 20) ELSE rand(5) * 1e-3 END AS x").union(spark.sql("SELECT CAST(NULL AS DOUBLE) UNION ALL SELECT CAST('NaN' AS DOUBLE)"))
    values = sorted(r.x for r in skewed.where("x IS NOT NULL AND NOT isnan(x)").collect())
    for reach in (20_000, 700, 90):
        found = [tuple(r) for r in paged.adaptive_ranges(skewed, "x", reach).collect()]
        assert sum(n for _, _, n in found) == len(values)
        assert all(n <= reach or lo == hi for lo, hi, n in found)
        assert all(a[1] < b[0] for a, b in zip(sorted(found), sorted(found)[1:], strict=False))
        assert all(n == sum(lo <= v <= hi for v in values) for lo, hi, n in found[:20])
        assert len(found) <= 40 + 6 * len(values) // reach
    assert [tuple(r) for r in paged.adaptive_ranges(spark.range(5).selectExpr("3 AS x"), "x", 2).collect()] == [(3.0, 3.0, 5)]
    assert paged.adaptive_ranges(skewed.where("false"), "x", 2).count() == 0


def test_sketches_merge(spark, tmp_path):
    from tidewell.operators import sketches

    crawled = spark.range(40_000).selectExpr("concat('s', id % 2) AS source", "id div 400 AS page", "concat('item ', pmod(id * 7919, IF(id % 2 = 0, 3000, 20000))) AS item")
    sketches.page_sketches(crawled).write.parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    exact = {r.source: r.n for r in crawled.groupBy("source").agg(F.countDistinct("item").alias("n")).collect()}
    for r in sketches.repeats(stored).collect():
        assert r.found == 20_000 and r.pages == 100 and abs(r.fresh - exact[r.source]) < 0.08 * exact[r.source]
    halves = sketches.merged(stored.where("page < 50"), "source").collect()
    assert all(r.fresh < exact[r.source] * 1.08 and r.found == 10_000 for r in halves)
    covered = sketches.coverage(stored, spark.createDataFrame([("s0", 6000)], "source string, total long")).collect()
    assert len(covered) == 1 and 20 < covered[0].coverage_pct < 56


def test_halved_ranges_are_those_of_the_sql(spark, tmp_path):
    """A price that many share, prices that differ by cents, beyond the axis, negative, null and not finite; few orders and none."""
    import duckdb
    from tidewell.catalog import ORACLES, QUERIES

    name = "src_17_adaptive_ranges"
    usual = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 1024.5D WHEN id % 3 = 1 THEN 5000 + id * 0.01D ELSE id * 171.13D END AS o_totalprice")
    odd = spark.sql("SELECT CAST(x AS DOUBLE) AS o_totalprice FROM (SELECT explode(array('NaN', 'Infinity', NULL, '-0.5', '-3000000', '1e-12', '4194304', '2097152')) AS x)")
    for k, frame in enumerate((usual, usual.union(odd), usual.limit(5), odd, usual.where("false"))):
        frame.write.parquet(f"{tmp_path}/{k}/orders.parquet")
        values = [r[0] for r in frame.collect() if r[0] is not None and abs(r[0]) < float("inf")]
        got = sorted(map(tuple, QUERIES[name](spark, f"{tmp_path}/{k}").collect()))
        connection = duckdb.connect()
        connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/{k}/orders.parquet/*.parquet'")
        assert got == sorted(connection.execute(ORACLES[name]).fetchall())
        assert [n for lo, hi, n in got] == [sum(lo <= v < hi for v in values) for lo, hi, n in got] and sum(n for _, _, n in got) == len(values)
        assert all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
        assert all(n <= len(values) // 16 or len({v for v in values if lo <= v < hi}) == 1 for lo, hi, n in got)


def test_boards_are_walked_in_one_pass(spark, sf_dir):
    """The listings are read once, however many pages a board has."""
    from tidewell.catalog import connectors

    frame = connectors.posted_pages(spark, sf_dir)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "o_orderkey" in line for line in plan.splitlines()) <= 1
