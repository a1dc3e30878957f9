"""The billing domain over the test tables: one neutral SQL text for each view, read by Spark and by the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "customers": """select c_custkey as customer_id, c_name as name, n_name as country, lower(c_mktsegment) as loyalty_tier,
        case when c_acctbal >= 0 then 1 else 0 end as is_active, s.signup_date
        from {customer} join {nation} on c_nationkey = n_nationkey
        left join (select o_custkey, cast(min(o_orderdate) as date) as signup_date from {orders} group by o_custkey) s on s.o_custkey = c_custkey""",
    "transactions": """select o_custkey as customer_id, cast(l_shipdate as date) as transaction_date,
        cast(l_extendedprice * (1 - l_discount) as decimal(18,4)) as amount,
        case when l_returnflag = 'N' then 'completed' when l_returnflag = 'R' then 'refunded' else 'failed' end as status
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "subscriptions": """select o_orderkey as subscription_id, o_custkey as customer_id, o_orderpriority as plan_name,
        floor((round(o_totalprice * 100) + 6) / 12.0) / 100.0 as mrr, cast(o_orderdate as date) as start_date,
        case when o_orderstatus = 'O' then cast(null as date) else cast(cast(o_orderdate as date) + cast(o_orderkey % 365 + 1 as int) as date) end as end_date,
        case when o_orderstatus = 'O' then 'active' when o_orderstatus = 'F' then 'cancelled' else 'expired' end as status from {orders}""",
    "invoices": """select o_orderkey as invoice_id, o_custkey as customer_id, cast(cast(o_orderdate as date) + 30 as date) as due_date,
        case when o_orderstatus = 'F' then cast(l.paid as date) end as paid_date, case when o_orderstatus = 'F' then 'paid' else 'open' end as payment_status
        from {orders} left join (select l_orderkey, max(l_shipdate) as paid from {lineitem} group by l_orderkey) l on l_orderkey = o_orderkey""",
    "tickets": """select o_orderkey as ticket_id, o_custkey as customer_id,
        case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' else 'low' end as priority,
        case when o_orderstatus = 'F' then 'closed' when o_orderstatus = 'P' then 'resolved' else 'open' end as status,
        o_orderdate as created_at, l.first_at as first_response_at, l.last_at as resolved_at,
        cast(1 + o_orderkey % 5 as double) as rating, case when o_orderkey % 7 = 0 then 1 else 0 end as is_escalated
        from {orders} left join (select l_orderkey, min(l_shipdate) as first_at, max(l_shipdate) as last_at from {lineitem} group by l_orderkey) l on l_orderkey = o_orderkey""",
    "usage_events": """select event_id as usage_id, case when event_id % 17 = 0 then null else user_id end as customer_id, event_type as feature_name,
        cast(ts as date) as session_date, value as usage_count from {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    needed = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **needed)


def oracle(sql: str) -> str:
    """``sql`` with the views that it names before it."""
    import re

    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    text = ", ".join(f"{n} as ({VIEWS[n].replace('{', '').replace('}', '')})" for n in used)
    sql = sql.strip()
    if not text:
        return sql
    if sql.lower().startswith("with recursive "):
        return f"with recursive {text}, {sql[15:]}"
    return f"with {text}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {text} {sql}"
