import datetime

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerlake.functions import cleaning as C
from ledgerlake.operators import governance as G
from ledgerlake.operators import quality, warehouse
from ledgerlake.plans import billing, tools
from ledgerlake.plans.views import VIEWS, view
from ledgerlake.sources import readers
from ledgerlake.sources.schemas import SCHEMAS
from ledgerlake.streaming import events as streams

D = datetime.date


@pytest.fixture(scope="module")
def billed(spark):
    return {n: view(spark, SF, n) for n in VIEWS}


def test_wrong_parameters(billed):
    assert "nonexistent_metric" in tools.find_anomalies(billed, "nonexistent_metric", "2001-08-01")["error"]
    assert "error" in tools.find_anomalies(billed, "revenue", "2001-08-01", 366) and "error" in tools.find_anomalies(billed, "revenue", "2001-08-01", 90, 0.1)
    assert "error" in tools.make_forecast(billed, "transaction_volume") and "error" in tools.make_forecast(billed, "mrr", 90, "cubic")
    assert "error" in tools.segment_customers(billed, "age", "2002-12-31") and "error" in tools.segment_customers(billed, "rfm", "2002-12-31", 101)
    assert "error" in tools.revenue_calculator(billed, "2000-01-01", "2000-12-31", "hourly")


def test_revenue_calculator(billed):
    every = tools.revenue_calculator(billed, "2000-01-01", "2000-12-31")
    assert every["series"].count() == 12 and every["recurring"].columns == ["mrr", "arr", "arpc"]
    one = tools.revenue_calculator(billed, "2000-01-01", "2000-12-31", metric="arr")
    assert one["recurring"].columns == ["arr"] and "series" not in one


def test_segments(billed):
    for kind in tools.SEGMENTS:
        found = tools.segment_customers(billed, kind, "2002-12-31" if kind == "rfm" else "2024-01-30", 5)
        assert found["top"].count() <= 5 and set(found["distribution"].columns) == {"segment", "n"}


def test_knowledge_falls_back(spark):
    docs = spark.createDataFrame([("a.md", "# T\n## Refunds\nmoney back within thirty days\n\n" + "word " * 200)], "source string, text string")
    hit = tools.knowledge(docs, "refunds thirty", 1)["passages"].first()
    assert hit["citation"] == "[Source: a.md — Refunds]" and hit["score"] > 0
    assert [r["score"] for r in tools.knowledge(docs, "zebra", 1)["passages"].collect()] == [0.0]
    assert "error" in tools.knowledge(docs, "x", 9)


def test_conform(spark):
    rows = warehouse.conform(spark.createDataFrame([("c1", "yes", True)], "customer_id string, extra string, is_active boolean"), "customers")
    assert rows.columns == SCHEMAS["customers"].names and [f.dataType for f in rows.schema] == [f.dataType for f in SCHEMAS["customers"]]
    got = rows.first()
    assert (got["customer_id"], got["is_active"], got["company"], got["loyalty_tier"], got["email"]) == ("c1", 1, "Unknown", "unknown", None)


def test_load_checks(spark):
    tables = {"customers": spark.createDataFrame([("c1",)], "customer_id string"), "transactions": spark.createDataFrame([("t1", "c1", 5.0), ("t2", "c9", -5.0)], "transaction_id string, customer_id string, amount double")}
    found = {(r["check"], r["key"]): (r["value"], r["sample"]) for r in warehouse.checks(tables, {"customers": 3, "transactions": 2}).collect()}
    assert found["row_count", "customers"][0] == 2 and found["row_count", "transactions"][0] == 0
    assert found["constraint", "transactions.amount < 0"][0] == 1 and found["orphan", "transactions.customer_id"] == (1, "c9")
    rows = {r["key"]: r["status"] for r in quality.report(spark.createDataFrame([("null_pk", "a", 1, None), ("orphan", "b", 1, None), ("date_null", "c", 4, "open ends"), ("orphan", "d", 0, "")], "check string, key string, value long, note string")).collect()}
    assert rows == {"a": "FAIL", "b": "WARN", "c": "INFO", "d": "PASS"}


def test_priorities_in_their_order(billed):
    got = [r["priority"] for r in billing.ticket_funnel(billed["tickets"]).collect()]
    assert got == [p for p in ("critical", "high", "medium", "low") if p in got] and got


def test_names_and_routing(spark):
    assert spark.createDataFrame([("A", "B"), ("A", None)], "a string, b string").select(C.full_name(F.col("a"), F.col("b")).alias("n")).collect() == [("A B",), (None,)]
    r = G.routing(spark.createDataFrame([(["x", "y"], ["y"]), (["x"], ["x", "z"]), ([], ["z"])], "expected_tools array<string>, tools_used array<string>")).collect()
    assert [(x["missing"], x["passed"], x["any_expected"]) for x in r] == [(["x"], False, True), ([], True, True), ([], True, False)]


def test_governed_answers(spark, tmp_path):
    rows, notes = G.apply_all(spark.range(1500).select(F.lit("jane.d@x.io").alias("note")), 0.2)
    assert rows.count() == 1000 and rows.first()["note"] == "ja***@x.io" and len(notes) == 2
    assert G.apply_all(spark.range(5), 0.9)[1] == []
    audit, queue = G.Audit(spark, str(tmp_path / "a")), G.Queue(spark, str(tmp_path / "q"))
    assert "error" in G.guarded_sql(spark, "show notes", "select nothing_like_it from range(3)", audit, queue)
    fixed = G.guarded_sql(spark, "show notes", "select nothing_like_it from range(3)", audit, queue, 9999, lambda sql, error: "select id from range(600)")
    assert fixed["data"].count() == 500
    held = G.guarded_sql(spark, "find fraud", "select 1", audit, queue)
    assert [r["id"] for r in queue.list_all().collect()] == [held["queue_id"]] and audit.history(tool="sq")[0] >= 1


def test_stream_log_goes_on(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.limit(100).write.parquet(str(tmp_path / "in"))
    for expected in (100, 150):
        query = streams.append_to(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "state"))
        query.awaitTermination(60)
        assert streams.job_state(query)["status"] == "done" and spark.read.parquet(str(tmp_path / "log")).count() == expected
        rows.limit(50).write.mode("append").parquet(str(tmp_path / "in"))


def test_absent_sources(spark, tmp_path):
    assert readers.read_index(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        readers.read_markdown(spark, str(tmp_path))
