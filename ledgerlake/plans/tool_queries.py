"""Queries of the tools and of the load checks over the test tables, with SQL of their own for the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import cleaning as C
from ledgerlake.operators import governance as G
from ledgerlake.operators import quality as Q
from ledgerlake.operators import retrieval as R
from ledgerlake.operators import warehouse as WH
from ledgerlake.plans import tools as T
from ledgerlake.plans.views import VIEWS, view
from ledgerlake.sources.readers import calendar

REF, LAST = "2001-08-01", "2002-12-31"
EXPECTED = ("1-URGENT", "2-HIGH")


def _tables(s, d):
    return {n: view(s, d, n) for n in VIEWS}


def _read(s, d, t):
    return s.read.parquet(f"{d}/{t}.parquet")


def _routing(s, d):
    used = _read(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("tools_used"))
    found = G.routing(used.withColumn("expected_tools", F.array(*[F.lit(x) for x in EXPECTED])))
    return found.select("o_custkey", F.array_join("missing", ",").alias("missing"), F.col("passed").cast("int").alias("passed"), F.col("any_expected").cast("int").alias("any_expected"))


def _violations(s, d):
    """Constraints on tables of which every seventh value is out of its range."""
    out = lambda df, key, c, v: df.withColumn(c, F.when(F.col(key) % 7 == 0, F.lit(v)).otherwise(F.col(c)))
    tables = {
        "transactions": _read(s, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("amount")), "subscriptions": view(s, d, "subscriptions"),
        "support_tickets": view(s, d, "tickets"), "date_dim": calendar(s),
    }
    tables["transactions"] = out(tables["transactions"], "l_orderkey", "amount", -1.0)
    tables["support_tickets"] = out(tables["support_tickets"], "ticket_id", "rating", 9.0)
    return WH.violations(tables).select("check", "key", "value")


def _references(s, d):
    """Orphans of every foreign key of the test tables, to parents of which every 23rd is missing."""
    pairs = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"))
    found = None
    for child, key, parent, own in pairs:
        one = Q.orphans(_read(s, d, child), key, _read(s, d, parent).where(F.col(own) % 23 != 0), own)
        one = one.select(F.lit(f"{child}.{key}").alias("key"), "value", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))
        found = one if found is None else found.unionByName(one)
    return found


QUERIES = {
    "an1_transaction_volume": lambda s, d: T.find_anomalies(_tables(s, d), "transaction_volume", REF, 365, 2.0)["anomalies"],
    "an1_ticket_count": lambda s, d: T.find_anomalies(_tables(s, d), "ticket_count", REF, 365, 2.0)["anomalies"],
    "an1_mrr": lambda s, d: T.find_anomalies(_tables(s, d), "mrr", REF, 365, 1.0)["anomalies"],
    "fc1_mrr": lambda s, d: T.make_forecast(_tables(s, d), "mrr")["forecast"],
    "fc1_ticket_count": lambda s, d: T.make_forecast(_tables(s, d), "ticket_count")["forecast"],
    "sg1_distribution": lambda s, d: T.segment_customers(_tables(s, d), "rfm", LAST)["distribution"],
    "sg1_top": lambda s, d: T.segment_customers(_tables(s, d), "rfm", LAST)["top"],
    "sg4_health_top": lambda s, d: T.segment_customers(_tables(s, d), "health_score", LAST)["top"],
    "dt5_last_year": lambda s, d: T.recent_revenue(view(s, d, "transactions"), REF),
    "str1_full_name": lambda s, d: _read(s, d, "customer").select("c_custkey", C.full_name(F.col("c_name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))).alias("name")),
    "str10_citation": lambda s, d: _read(s, d, "documents").select("doc_id", R.citation("source", "lang").alias("citation")),
    "set2_routing": _routing,
    "val2_references": _references,
    "lck4_constraints": _violations,
}


def _anomaly(points: str, sensitivity: float) -> str:
    return f"""with p as ({points}), s as (select *, avg(value) over () as mu, stddev_pop(value) over () as sd from p)
        select period, round(value, 2) as value, round(abs(value - mu) / (sd + 1e-9), 3) as score, case when value > mu then 'spike' else 'drop' end as direction from s where abs(value - mu) / (sd + 1e-9) > {sensitivity}"""


def _line(points: str) -> str:
    return f"""with p as ({points}), s as (select *, row_number() over (order by period) - 1 as x, count(*) over () as n, max(period) over () as last from p),
        f as (select regr_slope(value, x) as a, regr_intercept(value, x) as b, any_value(n) as n, any_value(last) as last from s), c as (select 1.96 * stddev_pop(value - (a * x + b)) as ci from s, f),
        i as (select unnest(generate_series(1, 3)) as i)
        select strftime(last + to_months(cast(i as int)), '%Y-%m') as month, round(a * (n + i - 1) + b, 2) as predicted, round(a * (n + i - 1) + b - ci, 2) as low, round(a * (n + i - 1) + b + ci, 2) as high from f, c, i"""


_SINCE = f"date '{REF}' - 365"
_MRR = "select cast(date_trunc('month', start_date) as date) as period, cast(round(sum(cast(mrr as decimal(18,4))), 2) as double) as value from subscriptions where status = 'active' {} group by 1"


def _lost(child: str, key: str, parent: str, own: str) -> str:
    lost = f"from {child} where {key} not in (select {own} from {parent} where {own} % 23 <> 0)"
    return f"select '{child}.{key}' as key, (select count(*) {lost}) as value, coalesce((select string_agg(cast(k as varchar), ',' order by k) from (select distinct {key} as k {lost} order by 1 limit 5)), '') as sample"


def oracle(base: dict[str, str]) -> dict[str, str]:
    """``base``: the SQL of the plans that some of these queries are the top of."""
    return {
        "an1_transaction_volume": _anomaly(f"select transaction_date as period, cast(count(*) as double) as value from transactions where transaction_date >= {_SINCE} group by 1", 2.0),
        "an1_ticket_count": _anomaly(f"select cast(created_at as date) as period, cast(count(*) as double) as value from tickets where cast(created_at as date) >= {_SINCE} group by 1", 2.0),
        "an1_mrr": _anomaly(_MRR.format(f"and start_date >= {_SINCE}"), 1.0),
        "fc1_mrr": _line(_MRR.format("")),
        "fc1_ticket_count": _line("select cast(date_trunc('month', created_at) as date) as period, cast(count(*) as double) as value from tickets where created_at is not null group by 1"),
        "sg1_distribution": f"select segment, count(*) as n from ({base['sg1_rfm']}) group by segment",
        "sg1_top": f"select * from ({base['sg1_rfm']}) order by rfm_total desc, customer_id limit 10",
        "sg4_health_top": f"select * from ({base['q3_health']}) order by health_score desc, customer_id limit 10",
        "dt5_last_year": f"select strftime(transaction_date, '%Y-%m') as month, cast(round(sum(amount), 2) as double) as revenue from transactions where status = 'completed' and transaction_date between date '{REF}' - interval 12 month and date '{REF}' group by 1",
        "str1_full_name": "select c_custkey, c_name || ' ' || case when c_custkey % 3 > 0 then c_mktsegment end as name from customer",
        "str10_citation": "select doc_id, '[Source: ' || source || ' — ' || lang || ']' as citation from documents",
        "set2_routing": """with u as (select o_custkey, count(*) filter (where o_orderpriority = '1-URGENT') as a, count(*) filter (where o_orderpriority = '2-HIGH') as b from orders group by 1)
            select o_custkey, concat_ws(',', case when a = 0 then '1-URGENT' end, case when b = 0 then '2-HIGH' end) as missing, case when a > 0 and b > 0 then 1 else 0 end as passed, case when a > 0 or b > 0 then 1 else 0 end as any_expected from u""",
        "val2_references": " union all ".join(_lost(*p) for p in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"))),
        "lck4_constraints": """select 'constraint' as check, 'transactions.amount < 0' as key, count(*) as value from lineitem where l_orderkey % 7 = 0 union all select 'constraint', 'subscriptions.mrr < 0', count(*) from subscriptions where mrr < 0
            union all select 'constraint', 'support_tickets.rating < 1 or rating > 5', count(*) from tickets where ticket_id % 7 = 0 union all select 'constraint', 'date_dim.quarter not between 1 and 4', 0 union all select 'constraint', 'date_dim.month not between 1 and 12', 0""",
    }
