import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import cleaning as C
from ledgerlake.operators import governance as G
from ledgerlake.operators import quality, retrieval, tables, warehouse
from ledgerlake.plans import metrics
from ledgerlake.sources import readers
from ledgerlake.streaming import events as streams

D = datetime.date


def values(spark, cleaner, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(cleaner(F.col("t"))).collect()]


def test_cleaners(spark):
    assert values(spark, C.currency, ["$100.50", "USD 507.90", "AED 365.94", "$ 826.53", "999.0", "-50.00", "not_a_number", None]) == [100.5, 507.9, 365.94, 826.53, 999.0, -50.0, None, None]
    assert values(spark, C.date, ["2023-01-15", "15/06/2022", "May 15, 2024", "2023-06-24T00:00:00+00:00", "2022/12/18", "07/23/2024 00:00-05:00", "10-Apr-2025", "07-21-2022", "06/07/2023", "soon", None]) == [
        D(2023, 1, 15), D(2022, 6, 15), D(2024, 5, 15), D(2023, 6, 24), D(2022, 12, 18), D(2024, 7, 23), D(2025, 4, 10), D(2022, 7, 21), D(2023, 6, 7), None, None]
    assert values(spark, C.rating, ["4", "four", "4/5", "8/10", "3.5", "7", "excellent", None]) == [4.0, 4.0, 4.0, 4.0, 3.5, 5.0, None, None]
    assert values(spark, C.boolean, ["true", "Yes", "1", "Y", "False", "no", "0", "N", "x", None]) == [True] * 4 + [False] * 4 + [None, None]
    assert values(spark, C.plain_text, ["<p>Hi</p>", "[a](http://b)", "**b**", "plain", "<br>", None]) == ["Hi", "a", "b", "plain", None, None]
    assert values(spark, C.category, [" High ", "NaN", "none", "", None]) == ["high", None, None, None, None]
    assert values(spark, C.mask_pii, ["mail john.doe@x.com", "jd@x.com", "Call 555-867-5309", "42 rows"]) == ["mail jo***@x.com", "***@x.com", "Call[PHONE REDACTED]", "42 rows"]


def test_ingest_clean_load(spark, tmp_path):
    (tmp_path / "customers.json").write_text(json.dumps([{"customer_id": "c1", "name": {"first": "A", "last": "B"}, "address": {"city": "X", "country": "Y", "zip": "1"}, "email": None, "is_active": True}, {"customer_id": "c2", "name": {"first": "C", "last": "D"}, "address": {"city": "X", "country": "Y", "zip": "2"}, "email": "e@f.g", "is_active": "no"}]))
    for name in readers.CSV_TABLES:
        (tmp_path / f"{name}.csv").write_text({
            "transactions": "﻿transaction_id,customer_id,amount,currency,status,transaction_date\nt1,c1,$5,usd,Completed,2024-01-02\nt1,c1,$9,usd,x,2024-01-02\nt2,c9,-3,usd,failed,01/05/2024\n",
            "subscriptions": "subscription_id,customer_id,plan_name,mrr,currency,start_date,end_date,status\ns1,c1,Professional,10,usd,2024-01-01,,active\n",
            "invoices": "invoice_id,customer_id,subtotal,tax,paid_amount,currency\ni1,c1,100,60,N/A,usd\n",
            "support_tickets": "ticket_id,customer_id,priority,rating,is_escalated\nk1,c1,crit,five,yes\n",
            "product_usage": "usage_id,customer_id,feature_name,session_duration_seconds,usage_count\nu1,,dashbord,-5,20000\nu1,,dashbord,-5,20000\n",
        }[name], encoding="utf-8")
    raw = readers.ingest(spark, str(tmp_path))
    clean = tables.clean_all(raw, today="2024-06-01")
    assert {r["table_name"]: r["removed"] for r in tables.summary(raw, clean).collect()} == {"customers": 0, "transactions": 1, "subscriptions": 0, "invoices": 0, "support_tickets": 0, "product_usage": 1}
    t2 = clean["transactions"].where("transaction_id = 't2'").first()
    assert (t2["amount"], t2["was_negative"], t2["currency"], t2["transaction_date"]) == (3.0, 1, "USD", D(2024, 1, 5))
    usage = clean["product_usage"].first()
    assert (usage["feature_name"], usage["session_duration_seconds"], usage["duration_invalid"], usage["usage_count_outlier"], usage["customer_id_missing"]) == ("dashboard", None, 1, 1, 1)
    assert clean["invoices"].first()["tax_error_flag"] == 1 and clean["subscriptions"].first()["plan_name"] == "pro" and clean["support_tickets"].first()["priority"] == "critical"
    loaded = warehouse.load(spark, clean, str(tmp_path / "wh"))
    found = {(r["check"], r["key"]): r["value"] for r in warehouse.checks(loaded).collect()}
    assert found["orphan", "transactions.customer_id"] == 1 and found["null_pk", "customers"] == 0
    quality.require_keys({"customers": loaded["customers"]}, tables.KEYS)
    assert loaded["date_dim"].count() == 2191
    warehouse.write_report(quality.report(warehouse.checks(loaded)), str(tmp_path / "report"))
    with pytest.raises(ValueError):
        quality.require_keys({"customers": spark.createDataFrame([(None,)], "customer_id string")}, tables.KEYS)


def test_classifier_and_guard(spark, tmp_path):
    cases = {"show revenue": "safe", "delete all rows": "blocked", "list email of users": "requires_review", "export all customers": "requires_review", "find fraud": "requires_review", "any anomaly?": "safe"}
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    assert {r[0]: r[1] for r in df.select("q", G.classify(F.col("q"))["classification"]).collect()} == cases
    audit, queue = G.Audit(spark, str(tmp_path / "a")), G.Queue(spark, str(tmp_path / "q"))
    spark.createDataFrame([(1, "jane.d@x.io")], "id int, note string").createOrReplaceTempView("t_guard")
    ok = G.guarded_sql(spark, "show notes", "select id, note from t_guard", audit, queue)
    assert ok["classification"] == "safe" and ok["data"].first()["note"] == "ja***@x.io"
    assert G.guarded_sql(spark, "q", "drop table t_guard", audit, queue)["data"] is None
    held = G.guarded_sql(spark, "find fraud", "select 1", audit, queue)
    queue.decide(held["queue_id"], True)
    assert queue.get(held["queue_id"])["status"] == "approved"
    with pytest.raises(ValueError, match="already"):
        queue.decide(held["queue_id"], False)
    with pytest.raises(ValueError, match="not found"):
        queue.decide("999999", False)
    assert audit.history()[0] == 3 and audit.history(classification="blocked")[0] == 1 and audit.history(tool="sql")[0] == 3
    assert audit.stats()[1].first()["count"] == 3
    assert G.limit_rows(spark.range(1500))[1] is not None and G.limit_rows(spark.range(50))[1] is None
    assert G.reflect("revenue?", "select sum(amount)", "Revenue was 5 in the month of May.", [{"amount": 1}])[0]
    assert not G.reflect("revenue?", "select sum(amount)", "Revenue was 5 in the month of May.", [{"amount": -1}])[0]
    assert not G.reflect("x", "", "", [])[0]
    assert G.confidence_warning(0.4) and not G.confidence_warning(0.9)
    assert G.chart_data(spark, "select id, id * 2 as v from range(3)").count() == 3


def test_retrieval(spark, tmp_path):
    text = "# Title\nintro\n## Part\n" + "\n\n".join("word " * 40 for _ in range(4)) + "\n### Sub\nrefund within days"
    (tmp_path / "a.md").write_text(text)
    rows = retrieval.chunk(readers.read_markdown(spark, str(tmp_path))).collect()
    assert [r["section"] for r in rows][:1] == ["Overview"] and rows[-1]["section"] == "Sub" and len(rows) > 4
    assert all(r["doc_title"] == "Title" for r in rows)
    hit = retrieval.keyword(retrieval.chunk(readers.read_markdown(spark, str(tmp_path))), "refund days", 1).first()
    assert hit["section"] == "Sub"
    assert readers.labelled_sql("-- Q1 a\nselect 1;\n-- Q2 b\nselect 2;") == {"Q1": "select 1", "Q2": "select 2"}


def test_metrics_fixtures(spark):
    t = spark.createDataFrame([("c", D(2025, 1, 5), 100.0, "completed"), ("c", D(2025, 3, 5), 300.0, "completed")], "customer_id string, transaction_date date, amount double, status string")
    assert [r["revenue"] for r in metrics.revenue(t, "2025-01-01", "2025-12-31").orderBy("period").collect()] == [100.0, 0.0, 300.0]
    s = spark.createDataFrame([("a", 500.0, "active"), ("b", 300.0, "active")], "customer_id string, mrr double, status string")
    assert tuple(metrics.recurring(s).first()) == (800.0, 9600.0, 400.0)
    days = spark.createDataFrame([(D(2025, 12, 31) - datetime.timedelta(i), 9999.0 if i == 0 else 100.0) for i in range(30)], "period date, value double")
    spikes = metrics.anomalies(days, "2025-12-31", 60, 2.0, "zscore").collect()
    assert len(spikes) == 1 and spikes[0]["direction"] == "spike"
    n = spark.createDataFrame([(f"c{i}", D(2025, 1, 1), 1.0, "completed") for i in range(7)], "customer_id string, transaction_date date, amount double, status string")
    assert sorted(r["f"] for r in metrics.rfm(n, "2025-12-31").collect()) == [1, 1, 2, 3, 4, 5, 5] or metrics.rfm(n, "2025-12-31").count() == 7


def test_streaming(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(200).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.daily(stream).writeStream.outputMode("complete").format("memory").queryName("daily_counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("daily_counts").agg(F.sum("n")).first()[0] == 200


def test_money_columns_of_reflection():
    answer = "Revenue was 5 in the month of May."
    assert not G.reflect("revenue?", "select sum(amount)", answer, [{"Paid_Amount": -5}])[0]
    assert not G.reflect("revenue?", "select sum(amount)", answer, [{"subtotal": -5.0}])[0]
    assert G.reflect("revenue?", "select sum(amount)", answer, [{"arr": -5}])[0]


def test_masking_of_nested_values(spark):
    df = spark.sql("select named_struct('a', 'jane@x.org', 'n', 3) as s, array('call 555-123-4567', null) as l, map('k', array('bob@x.org')) as m, 7 as n")
    assert G.mask_all(df).first().asDict(True) == {"s": {"a": "ja***@x.org", "n": 3}, "l": ["call[PHONE REDACTED]", None], "m": {"k": ["bo***@x.org"]}, "n": 7}


def test_chunks_are_numbered_through_the_document(spark):
    long = "\n\n".join(f"paragraph {i} " + "word " * 30 for i in range(4))
    text = f"before any heading\n\n## Terms\n{long}\n\n## Terms\nmore of it"
    rows = retrieval.chunk(spark.createDataFrame([("refund_policy.md", text)], "source string, text string")).collect()
    assert [r["chunk_id"] for r in rows] == [f"refund_policy.md::{s}::{i}" for i, s in enumerate(["Overview", *["Terms"] * (len(rows) - 1)])]
    assert {r["doc_title"] for r in rows} == {"Refund Policy"} and all(r["text"] == r["text"].strip() for r in rows)
    assert retrieval.chunk(spark.createDataFrame([("a.md", "# One\nx")], "source string, text string")).first()["doc_title"] == "One"


def test_first_row_of_a_key_stays(spark):
    raw = spark.createDataFrame([("u1", f"c{i}", "sandox", "5", "1") for i in range(400)], "usage_id string, customer_id string, feature_name string, session_duration_seconds string, usage_count string").repartition(1)
    first = raw.first()["customer_id"]
    assert [r["customer_id"] for r in tables.clean("product_usage", raw.coalesce(1)).collect()] == [first]
