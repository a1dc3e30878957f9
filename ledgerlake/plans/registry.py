"""Every analytical query over the test tables, with independent SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import cleaning as C
from ledgerlake.operators import governance as G
from ledgerlake.operators import quality as Q
from ledgerlake.operators import retrieval as R
from ledgerlake.operators import tables as T
from ledgerlake.plans import billing as B
from ledgerlake.plans import metrics as M
from ledgerlake.plans import tool_queries
from ledgerlake.plans.views import oracle, view
from ledgerlake.sources.readers import calendar
from ledgerlake.streaming import events as S

FIRST, LAST = "1995-01-01", "2002-12-31"
REF = "2001-08-01"
USAGE_REF = "2024-01-30"
QUERY = "the onward tion"


def _read(s, d, t):
    return s.read.parquet(f"{d}/{t}.parquet")


def _v(*names):
    return lambda s, d: [view(s, d, n) for n in names]


def _daily(s, d):
    t = view(s, d, "transactions").where("status = 'completed'")
    return t.groupBy(F.col("transaction_date").alias("period")).agg(F.sum("amount").cast("double").alias("value"))


def _monthly(s, d):
    t = view(s, d, "transactions").where("status = 'completed'")
    return t.groupBy(F.trunc("transaction_date", "MM").alias("period")).agg(F.sum("amount").cast("double").alias("value"))


def _dirty(s, d):
    """Texts to clean, made from keys by the same rule as in the oracle."""
    k = F.col("o_orderkey")
    return _read(s, d, "orders").select(
        k, F.when(k % 5 == 0, F.concat(F.lit("$"), k, F.lit(".50"))).when(k % 5 == 1, F.concat(F.lit("USD "), k)).when(k % 5 == 2, F.concat(F.lit("-"), k, F.lit(".25"))).when(k % 5 == 3, "n/a").alias("amount"),
        F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("soon").alias("day"),
        F.when(k % 3 == 0, " Yes ").when(k % 3 == 1, "0").otherwise("maybe").alias("flag"), F.when(k % 4 == 0, "four").when(k % 4 == 1, "8/10").when(k % 4 == 2, "7").otherwise("fine").alias("score"),
        F.when(k % 3 == 0, " Crit ").when(k % 3 == 1, "NaN").otherwise("low").alias("priority"),
    )


def _cleaned(s, d):
    x = _dirty(s, d)
    return x.select("o_orderkey", C.currency(F.col("amount")).alias("amount"), C.date(F.col("day")).alias("day"), C.boolean(F.col("flag")).cast("int").alias("flag"), C.rating(F.col("score")).alias("score"), C.canonical(C.category(F.col("priority")), T.PRIORITIES).alias("priority"))


def _raw_transactions(s, d):
    """Strings as a CSV file holds them, every fourth amount negative, made by the same rule as in the oracle."""
    k = F.col("o_orderkey")
    return _read(s, d, "orders").select(
        F.concat(F.lit("t"), k).alias("transaction_id"), F.col("o_custkey").cast("string").alias("customer_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("transaction_date"),
        F.concat(F.when(k % 4 == 0, "-").otherwise("$"), (k % 1000).cast("string"), F.lit(".50")).alias("amount"), F.when(k % 2 == 0, "usd").otherwise("Eur").alias("currency"), F.when(k % 3 == 0, " Completed ").otherwise("FAILED").alias("status"), F.when(k % 5 > 0, "Card").alias("payment_method"),
    )


def _raw_usage(s, d):
    """Every event twice, durations and counts made from its number by the same rule as in the oracle."""
    k, e = F.col("event_id"), _read(s, d, "events")
    rows = e.select(
        F.concat(F.lit("u"), k).alias("usage_id"), F.when(k % 7 > 0, F.col("user_id").cast("string")).alias("customer_id"), F.when(k % 3 == 0, "dashbord").when(k % 3 == 1, "Analytic").otherwise("sandox").alias("feature_name"),
        (k % 50 - 5).cast("string").alias("session_duration_seconds"), F.when(k % 11 == 0, "20000").otherwise((k % 9).cast("string")).alias("usage_count"), F.when(k % 4 > 0, "Web").alias("device"),
    )
    return rows.unionByName(rows)


def _keep_first(s, d):
    return T.keep_first(_read(s, d, "lineitem"), "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _nearest(s, d, k=10):
    v = _read(s, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()
    return R.nearest(v, q[0] if q else [1.0], k)


def _hybrid(s, d, k=10):
    sem = _nearest(s, d, 3 * k).withColumnRenamed("vec_id", "doc_id")
    return R.hybrid(sem, R.bm25(_read(s, d, "documents"), QUERY, "doc_id"), "doc_id", k).select("doc_id", F.round("score", 4).alias("score"))


QUERIES = {
    "q1_cohort": lambda s, d: B.cohort(*_v("customers", "transactions")(s, d)),
    "q1b_cohort_calendar": lambda s, d: B.cohort_calendar(*_v("customers", "transactions")(s, d)),
    "q2_mrr_waterfall": lambda s, d: B.waterfall(view(s, d, "subscriptions"), FIRST, LAST),
    "q2b_mrr_waterfall_spine": lambda s, d: B.waterfall(view(s, d, "subscriptions"), FIRST, LAST, whole_months=True),
    "q3_health": lambda s, d: B.health(*_v("customers", "transactions", "tickets", "usage_events", "invoices")(s, d)),
    "q4_overlap": lambda s, d: B.double_billing(view(s, d, "subscriptions")),
    "q5_ticket_funnel": lambda s, d: B.ticket_funnel(view(s, d, "tickets")),
    "q6_pareto": lambda s, d: B.pareto(*_v("transactions", "customers")(s, d)),
    "q7_feature_funnel": lambda s, d: B.feature_funnel(view(s, d, "usage_events"), 7),
    "q8_churn": lambda s, d: B.churn_signals(*_v("customers", "usage_events", "tickets")(s, d), days=7, login_days=3),
    "db1_dashboard": lambda s, d: B.dashboard(*_v("customers", "subscriptions", "tickets")(s, d)),
    "rv1_revenue_monthly": lambda s, d: M.revenue(view(s, d, "transactions"), FIRST, LAST, "monthly"),
    "rv1_revenue_weekly": lambda s, d: M.revenue(view(s, d, "transactions"), FIRST, LAST, "weekly"),
    "rv1_revenue_daily": lambda s, d: M.revenue(view(s, d, "transactions"), FIRST, LAST, "daily"),
    "rv1_recurring": lambda s, d: M.recurring(view(s, d, "subscriptions")),
    "sg1_rfm": lambda s, d: M.rfm(view(s, d, "transactions"), LAST),
    "sg2_churn_risk": lambda s, d: M.churn_risk(*_v("customers", "usage_events", "tickets")(s, d), ref=USAGE_REF, days=7),
    "sg3_usage_tier": lambda s, d: M.usage_tier(view(s, d, "usage_events"), USAGE_REF),
    "an1_zscore": lambda s, d: M.anomalies(_daily(s, d), REF, 365, 2.0, "zscore"),
    "an1_iqr": lambda s, d: M.anomalies(_daily(s, d), REF, 365, 1.5, "iqr"),
    "an1_rolling": lambda s, d: M.anomalies(_daily(s, d), REF, 365, 1.5, "rolling"),
    "fc1_linear": lambda s, d: M.forecast(_monthly(s, d), 180, "linear"),
    "fc1_exponential": lambda s, d: M.forecast(_monthly(s, d), 90, "exponential"),
    "rg2_knn": lambda s, d: _nearest(s, d).select("vec_id", F.round("score", 4).alias("score")),
    "rg3_bm25": lambda s, d: R.bm25(_read(s, d, "documents"), QUERY, "doc_id").select("doc_id", F.round("bm25", 4).alias("bm25")),
    "rg4_hybrid": _hybrid,
    "kr1_keyword": lambda s, d: R.keyword(_read(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("section")), QUERY, 10).select("chunk_id", F.round("score", 4).alias("score")),
    "rg1_chunks": lambda s, d: R.chunk(_read(s, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")),
    "pr1_profile": lambda s, d: Q.profile(_read(s, d, "customer")).select("column", "n_rows", "n_null", "n_unique", "min", "median", "max"),
    "pr1_duplicates": lambda s, d: Q.duplicates(_read(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey"),
    "val2_orphans": lambda s, d: Q.orphans(_read(s, d, "orders").where("o_custkey is not null"), "o_custkey", _read(s, d, "customer").where("c_custkey % 23 <> 0"), "c_custkey").select("value"),
    "val3_amounts": lambda s, d: Q.non_positive(_read(s, d, "customer"), "c_acctbal"),
    "val3_amounts_zero": lambda s, d: Q.non_positive(_read(s, d, "customer"), "c_acctbal", allow_zero=True),
    "val1_null_keys": lambda s, d: Q.null_keys({"customer": _read(s, d, "customer"), "events": _read(s, d, "events").withColumn("event_id", F.when(F.col("event_id") % 10 > 0, F.col("event_id")))}, {"customer": "c_custkey", "events": "event_id"}),
    "val4_dates": lambda s, d: Q.null_dates(view(s, d, "subscriptions"), "end_date"),
    "val5_overlaps": lambda s, d: Q.overlaps(view(s, d, "subscriptions")),
    "cln_columns": _cleaned,
    "cln7_keep_first": _keep_first,
    "cln6_plain_text": lambda s, d: _read(s, d, "pages").select("page_id", F.length(C.plain_text(F.col("html"))).cast("long").alias("n")),
    "gv1_classify": lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", G.classify(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("please delete "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("export all "), "text")).otherwise(F.col("text"))).alias("c")).select("conv_id", "turn", "c.classification", "c.rule"),
    "gv2_mask": lambda s, d: _read(s, d, "documents").select("doc_id", F.md5(C.mask_pii(F.col("text")).cast("binary")).alias("masked_md5")),
    "src5_calendar": lambda s, d: calendar(s, FIRST, LAST),
    "stm1_daily": lambda s, d: S.daily(_read(s, d, "events")),
    "stm2_sliding": lambda s, d: S.sliding(_read(s, d, "events")).select("day", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std")),
    "ag13_tier_counts": lambda s, d: M.distribution(M.usage_tier(view(s, d, "usage_events"), USAGE_REF), "tier").withColumnRenamed("count", "n"),
    "cln13_to_18_transactions": lambda s, d: T.clean("transactions", _raw_transactions(s, d), "2024-01-01"),
    "cln8_to_17_usage": lambda s, d: T.clean("product_usage", _raw_usage(s, d), "2024-01-01"),
    "stm3_sessions": lambda s, d: S.sessions(_read(s, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n")),
}

_MONTHS = (1, 2, 3, 6, 12)


def _cohort_sql(month: str, extra: str = "") -> str:
    revs = ", ".join(f"cast(round(coalesce(sum(case when m = {m} then amount end), 0), 2) as double) as rev_m{m}" for m in _MONTHS)
    rets = ", ".join(f"round(100.0 * count(distinct case when m = {m} then customer_id end) / nullif(cohort_size, 0), 1) as ret_m{m}" for m in _MONTHS)
    return f"""with base as (select customer_id, signup_date, strftime(signup_date, '%Y-%m') as cohort_month, count(customer_id) over (partition by strftime(signup_date, '%Y-%m')) as cohort_size
        from customers where signup_date is not null),
        x as (select b.*, t.amount, {month} + 1 as m from base b join transactions t using (customer_id) where t.status = 'completed' {extra})
        select cohort_month, cohort_size, {revs}, {rets} from x group by 1, 2"""


def _waterfall_sql(first: str, total: str = "") -> str:
    parts = ", ".join(f"cast(sum(case when kind = '{k}' then d else 0 end) as double) as {k}_mrr" for k in ("new", "expansion", "contraction", "churned"))
    return f"""with months as (select cast(unnest(generate_series(date '{FIRST}', date '{LAST}', interval 1 month)) as date) as month),
        by_month as (select customer_id, month, sum(cast(mrr as decimal(18,4))) as mrr from subscriptions join months on month >= {first} and month <= coalesce(end_date, date '2099-12-31')
        where status in ('active', 'cancelled', 'expired') group by 1, 2),
        l as (select *, coalesce(lag(mrr) over (partition by customer_id order by month), 0) as prev from by_month),
        k as (select *, mrr - prev as d, case when prev = 0 and mrr > 0 then 'new' when mrr = 0 and prev > 0 then 'churned' when mrr > prev then 'expansion' when mrr < prev then 'contraction' else 'unchanged' end as kind from l),
        g as (select month, {parts}, sum(d) as net from k where kind <> 'unchanged' group by month)
        select strftime(month, '%Y-%m') as month, new_mrr, expansion_mrr, contraction_mrr, churned_mrr, cast(net as double) as net_new_mrr{total} from g"""


def _series(trunc: str) -> str:
    return f"select {trunc} as period, cast(sum(amount) as double) as value from transactions where status = 'completed' group by 1"


def _anomaly_sql(extra: str, score: str, hit: str) -> str:
    return f"""with s0 as ({_series('transaction_date')}), s1 as (select * from s0 where period >= date '{REF}' - 365),
        s as (select *, avg(value) over () as mu, stddev_pop(value) over () as sd{extra} from s1)
        select period, round(value, 2) as value, round({score}, 3) as score, case when value > mu then 'spike' else 'drop' end as direction from s where {hit}"""


def _fifth(order: str) -> str:
    return f"greatest(1, ceil((row_number() over (order by {order}) - 1) * 5 / nullif(count(*) over () - 1, 0)))"


_SIGNALS = """u0 as (select *, {uref} as ref from usage_events), t0 as (select *, {tref} as ref, cast(created_at as date) as cd from tickets),
    u as (select customer_id, case when count(case when session_date >= ref - 7 then 1 end) < count(case when session_date >= ref - 14 and session_date < ref - 7 then 1 end) then 1 else 0 end as usage_decline,
    case when max(session_date) < max(ref) - {login} then 1 else 0 end as no_recent_login from u0 where customer_id is not null group by 1),
    t as (select customer_id, case when count(case when cd >= ref - 7 then 1 end) > count(ticket_id) / 6.0 * 1.5 and count(case when cd >= ref - 7 then 1 end) > 0 then 1 else 0 end as ticket_spike,
    case when avg(case when cd >= ref - 7 then rating end) < avg(rating) then 1 else 0 end as rating_drop from t0 group by 1),
    c as (select customer_id, name, coalesce(usage_decline, 0) as usage_decline, coalesce(ticket_spike, 0) as ticket_spike, coalesce(rating_drop, 0) as rating_drop, coalesce(no_recent_login, 1) as no_recent_login
    from customers left join u using (customer_id) left join t using (customer_id) where is_active = 1)"""

_BM25 = """w as (select doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z_\\pL]+')) as term from documents),
    dl as (select doc_id, len(regexp_extract_all(lower(text), '[0-9a-z_\\pL]+')) as dl from documents),
    n as (select count(*) as n, avg(dl) as avgdl from dl), tf as (select doc_id, term, count(*) as tf from w where term in ('the', 'onward', 'tion') group by 1, 2),
    df as (select term, count(*) as df from tf group by 1),
    sc as (select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from tf join df using (term) join dl using (doc_id), n group by 1),
    b as (select doc_id, s / (select max(s) from sc) as bm25 from sc)"""

ORACLE = {
    "q1_cohort": _cohort_sql("cast(trunc(date_diff('day', date_trunc('month', signup_date), date_trunc('month', transaction_date)) / 30.44) as int)"),
    "q1b_cohort_calendar": _cohort_sql("date_diff('month', signup_date, transaction_date)", "and t.amount > 0"),
    "q2_mrr_waterfall": _waterfall_sql("start_date"),
    "q2b_mrr_waterfall_spine": _waterfall_sql("date_trunc('month', start_date)", ", cast(sum(net) over (order by month rows unbounded preceding) as double) as cumulative_mrr"),
    "q3_health": """with r as (select customer_id, round(greatest(0, 100 - date_diff('day', max(transaction_date), (select max(transaction_date) from transactions)) / 180.0 * 100), 2) as rs from transactions where status = 'completed' group by 1),
        s as (select customer_id, count(*) as n, avg(rating) as r from tickets group by 1),
        u as (select customer_id, count(*) as n, count(distinct feature_name) as f from usage_events where session_date >= (select max(session_date) from usage_events) - 90 group by 1),
        p as (select customer_id, 100.0 * count(case when paid_date <= due_date and payment_status = 'paid' then 1 end) / nullif(count(due_date), 0) as ps from invoices group by 1),
        x as (select c.customer_id, coalesce(rs, 50) as a, round(greatest(0, 100 - coalesce(s.n, 0) * 5) * 0.5 + coalesce(s.r, 3.0) / 5.0 * 100 * 0.5, 2) as b, round(least(coalesce(u.n, 0) / 12.86 * 10, 100) * 0.6 + least(coalesce(u.f, 0) * 10.0, 100) * 0.4, 2) as c,
        coalesce(round(ps, 2), 50) as d from customers c left join r using (customer_id) left join s using (customer_id) left join u using (customer_id) left join p using (customer_id) where is_active = 1),
        y as (select *, cast(round(a * 100) * 30 + round(b * 100) * 25 + round(c * 100) * 25 + round(d * 100) * 20 as bigint) as raw from x)
        select customer_id, a as recency_score, b as support_score, c as usage_score, d as payment_score, ((raw + 50) // 100) / 100.0 as health_score, cast(dense_rank() over (order by raw desc) as int) as health_rank from y""",
    "q4_overlap": """with s as (select *, coalesce(end_date, date '2099-12-31') as e, row_number() over (partition by customer_id order by start_date, subscription_id) as rn from subscriptions),
        p as (select a.customer_id, a.subscription_id as sub_a, b.subscription_id as sub_b, b.start_date as start_b, date_diff('day', b.start_date, least(a.e, b.e)) as overlap_days,
        cast(floor((cast(round(least(a.mrr, b.mrr) * 100) as bigint) * date_diff('day', b.start_date, least(a.e, b.e)) * 2 + 30) / 60.0) as bigint) as cents
        from s a join s b on a.customer_id = b.customer_id and a.rn < b.rn and b.start_date < a.e and b.start_date >= a.start_date)
        select customer_id, sub_a, sub_b, start_b, cast(overlap_days as int) as overlap_days, cents / 100.0 as double_billed, cast(sum(cents) over (partition by customer_id order by start_b) as bigint) / 100.0 as running_double_billed from p where overlap_days > 0""",
    "q5_ticket_funnel": """with t as (select *, round(date_diff('microsecond', created_at, first_response_at) / 3.6e9, 2) as a, round(date_diff('microsecond', created_at, resolved_at) / 3.6e9, 2) as r from tickets),
        n as (select *, ntile(100) over (partition by priority order by a nulls first, ticket_id) as na, ntile(100) over (partition by priority order by r nulls first, ticket_id) as nr from t where r > 0),
        m as (select priority, avg(case when nr = 50 then r end) as p50 from n group by 1)
        select priority, count(*) as total_tickets, round(avg(case when na = 50 then a end), 2) as p50_response_hours, round(any_value(p50), 2) as p50_resolution_hours, round(avg(case when nr >= 95 then r end), 2) as p95_resolution_hours,
        round(100.0 * count(case when status in ('closed', 'resolved') and is_escalated = 0 then 1 end) / nullif(count(case when status in ('closed', 'resolved') then 1 end), 0), 1) as fcr_rate_pct,
        round(100.0 * count(case when is_escalated = 1 then 1 end) / count(*), 1) as escalation_rate_pct, count(case when r > 2 * p50 then 1 end) as outlier_tickets, round(avg(r), 2) as avg_resolution_hours from n join m using (priority) group by priority""",
    "q6_pareto": """with p as (select customer_id, name, cast(round(sum(amount), 2) as decimal(18,2)) as rev from transactions join customers using (customer_id) where status = 'completed' group by 1, 2),
        i as (select *, cast(rev * 100 as hugeint) as c, sum(cast(rev * 100 as hugeint)) over () as total from p),
        q as (select *, cast((c * 2000000 + total) // (2 * total) as bigint) as pct, row_number() over (order by rev desc, customer_id) as revenue_rank from i),
        c as (select *, cast(sum(pct) over (order by revenue_rank) as bigint) as cum from q)
        select customer_id, name, cast(rev as double) as total_revenue, pct / 10000.0 as revenue_pct, cast(revenue_rank as int) as revenue_rank, cum / 10000.0 as cumulative_pct,
        case when cum <= 500000 then 'Top 50%' when cum <= 800000 then 'Top 80%' when cum <= 900000 then 'Top 90%' else 'Tail' end as segment, case when pct > 50000 then 1 else 0 end as concentration_flag,
        round(cast(sum(pct * pct) over () as double) / 1e8 / 100, 2) as hhi from c""",
    "q7_feature_funnel": """with p as (select feature_name, customer_id, count(*) as n, count(case when session_date >= (select max(session_date) from usage_events) - 7 then 1 end) as r from usage_events where customer_id is not null group by 1, 2)
        select feature_name, count(*) as reached, count(case when n > 1 then 1 end) as activated, count(case when r >= 5 then 1 end) as power_users, round(100.0 * count(case when n > 1 then 1 end) / count(*), 1) as activation_rate,
        round(100.0 * count(case when r >= 5 then 1 end) / count(*), 1) as power_rate, round(avg(n), 2) as avg_sessions, round(avg(r), 2) as avg_recent_sessions from p group by 1""",
    "q8_churn": "with " + _SIGNALS.format(uref="(select max(session_date) from usage_events)", tref="(select max(cast(created_at as date)) from tickets)", login=3)
    + """ select *, usage_decline + ticket_spike + rating_drop + no_recent_login as churn_score, cast(dense_rank() over (order by usage_decline + ticket_spike + rating_drop + no_recent_login desc) as int) as churn_rank from c order by churn_score desc, customer_id limit 50""",
    "db1_dashboard": """select cast(sum(case when status = 'active' then cast(mrr as decimal(18,4)) end) as double) as mrr, cast(sum(case when status = 'active' then cast(mrr as decimal(18,4)) end) * 12 as double) as arr,
        (select count(*) from customers where is_active = 1) as active_customers, round(100.0 * count(distinct case when status = 'cancelled' then customer_id end) / count(distinct customer_id), 2) as churn_rate_pct,
        (select round(avg(date_diff('microsecond', created_at, resolved_at) / 3.6e9), 2) from tickets) as avg_resolution_hours, (select round((avg(rating) - 3) / 2 * 100, 1) from tickets) as nps_proxy from subscriptions""",
    "rv1_recurring": """select cast(sum(cast(mrr as decimal(18,4))) as double) as mrr, cast(sum(cast(mrr as decimal(18,4))) * 12 as double) as arr, round(cast(sum(cast(mrr as decimal(18,4))) as double) / count(distinct customer_id), 2) as arpc from subscriptions where status = 'active'""",
    "sg1_rfm": f"""with p as (select customer_id, date_diff('day', max(transaction_date), date '{LAST}') as recency, count(amount) as frequency, cast(round(sum(amount), 2) as double) as monetary from transactions where status = 'completed' group by 1),
        q as (select *, cast(6 - {_fifth('recency, customer_id')} as int) as r, cast({_fifth('frequency, customer_id')} as int) as f, cast({_fifth('monetary, customer_id')} as int) as m from p)
        select customer_id, cast(recency as int) as recency, frequency, monetary, r, f, m, r + f + m as rfm_total, case when r + f + m <= 5 then 'Hibernating' when r + f + m <= 8 then 'At Risk' when r + f + m <= 10 then 'Needs Attention' when r + f + m <= 12 then 'Loyal' else 'Champions' end as segment from q""",
    "sg2_churn_risk": "with " + _SIGNALS.format(uref=f"date '{USAGE_REF}'", tref=f"date '{USAGE_REF}'", login=14)
    + """ select customer_id, usage_decline + ticket_spike + no_recent_login as risk_score, case usage_decline + ticket_spike + no_recent_login when 0 then 'Healthy' when 1 then 'Low' when 2 then 'Medium' else 'High' end as risk from c""",
    "sg3_usage_tier": f"""select customer_id, count(*) as sessions, count(distinct feature_name) as features, case when count(*) <= 4 then 'Dormant' when count(*) <= 15 then 'Casual' when count(*) <= 49 then 'Regular' else 'Power User' end as tier
        from usage_events where customer_id is not null and session_date >= date '{USAGE_REF}' - 90 group by 1""",
    "an1_zscore": _anomaly_sql("", "abs(value - mu) / (sd + 1e-9)", "abs(value - mu) / (sd + 1e-9) > 2.0"),
    "an1_iqr": _anomaly_sql(", quantile_cont(value, 0.25) over () as q1, quantile_cont(value, 0.75) over () as q3", "abs(value - mu) / (q3 - q1 + 1e-9)", "value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)"),
    "an1_rolling": _anomaly_sql(", avg(value) over w as ra, coalesce(stddev_samp(value) over w, 1.0) as rs", "abs(value - ra) / (rs + 1e-9)", "abs(value - ra) / (rs + 1e-9) > 1.5").replace("from s1)", "from s1 window w as (order by period rows between 6 preceding and current row))"),
    "fc1_linear": f"""with s0 as ({_series("date_trunc('month', transaction_date)")}), s as (select *, row_number() over (order by period) - 1 as x, count(*) over () as n, max(period) over () as last from s0),
        f as (select regr_slope(value, x) as a, regr_intercept(value, x) as b, any_value(n) as n, any_value(last) as last from s), c as (select 1.96 * stddev_pop(value - (a * x + b)) as ci from s, f), i as (select unnest(generate_series(1, 6)) as i)
        select strftime(last + i * interval 1 month, '%Y-%m') as month, round(a * (n + i - 1) + b, 2) as predicted, round(a * (n + i - 1) + b - ci, 2) as low, round(a * (n + i - 1) + b + ci, 2) as high from f, c, i""",
    "rg2_knn": """with q as (select embedding as v from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(v as double[])), 4) as score from embeddings, q
        order by list_cosine_similarity(cast(embedding as double[]), cast(v as double[])) desc, vec_id limit 10""",
    "rg3_bm25": f"with {_BM25} select doc_id, round(bm25, 4) as bm25 from b",
    "rg4_hybrid": f"""with {_BM25}, q as (select embedding as v from embeddings where vec_id = 0), k as (select vec_id as doc_id, list_cosine_similarity(cast(embedding as double[]), cast(v as double[])) as sem from embeddings, q
        order by list_cosine_similarity(cast(embedding as double[]), cast(v as double[])) desc, vec_id limit 30),
        h as (select coalesce(k.doc_id, b.doc_id) as doc_id, 0.7e0 * coalesce(least(greatest(sem, 0), 1), 0) + 0.3e0 * coalesce(bm25, 0) as s from k full join b on k.doc_id = b.doc_id)
        select doc_id, round(s, 4) as score from h where s > 0 order by s desc, doc_id limit 10""",
    "kr1_keyword": """with w as (select doc_id, lower(text) as t, lower(source) as sec, list_distinct(regexp_extract_all(lower(text), '[0-9a-z_\\pL]+')) as ws from documents),
        s as (select doc_id, len(list_intersect(ws, ['onward', 'the', 'tion'])) / 3e0 * (case when contains(t, 'onward') then 1.5e0 else 1e0 end) * (case when contains(sec, 'onward') or contains(sec, 'the') or contains(sec, 'tion') then 1.3e0 else 1e0 end) as s from w)
        select doc_id as chunk_id, round(s, 4) as score from s where s > 0 order by s desc, doc_id limit 10""",
    "fc1_exponential": f"""with recursive s0 as ({_series("date_trunc('month', transaction_date)")}), s as (select *, row_number() over (order by period) as x, max(period) over () as last from s0),
        r as (select x, value as level, value - value as off from s where x = 1 union all select s.x, 0.3e0 * s.value + 0.7e0 * r.level, 0.3e0 * s.value + 0.7e0 * r.level - s.value from r join s on s.x = r.x + 1),
        f as (select (select level from r order by x desc limit 1) as v, (select 1.96e0 * stddev_pop(off) from r) as ci, (select max(last) from s) as last), i as (select unnest(generate_series(1, 3)) as i)
        select strftime(last + i * interval 1 month, '%Y-%m') as month, round(v, 2) as predicted, round(v - ci, 2) as low, round(v + ci, 2) as high from f, i""",
    "pr1_profile": " union all ".join(
        f"""select '{c}' as "column", count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {c}) as n_unique, min(try_cast({c} as double)) as min, median(try_cast({c} as double)) as median, max(try_cast({c} as double)) as max from customer"""
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    ),
    "pr1_duplicates": "select (select sum(n - 1) from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)) as duplicate_rows, (select sum(n - 1) from (select count(*) as n from lineitem group by l_orderkey)) as duplicate_keys",
    "val2_orphans": "select count(*) as value from orders where o_custkey not in (select c_custkey from customer where c_custkey % 23 <> 0)",
    "val3_amounts": "select count(*) as value from customer where c_acctbal <= 0",
    "val4_dates": "select count(case when end_date is null then 1 end) as value, round(100.0 * count(case when end_date is null then 1 end) / count(*), 2) as pct from subscriptions",
    "val5_overlaps": """with s as (select *, coalesce(end_date, date '2099-12-31') as e from subscriptions where status in ('active', 'paused'))
        select a.customer_id, a.subscription_id as first_id, b.subscription_id as second_id, cast(greatest(date_diff('day', b.start_date, least(a.e, b.e)), 0) as int) as days from s a join s b on a.customer_id = b.customer_id
        and (b.start_date > a.start_date or (b.start_date = a.start_date and b.subscription_id > a.subscription_id)) and b.start_date < a.e order by 1, 2, 3 limit 20""",
    "cln_columns": """select o_orderkey, case o_orderkey % 5 when 0 then o_orderkey + 0.5e0 when 1 then o_orderkey * 1e0 when 2 then -o_orderkey - 0.25e0 end as amount, case when o_orderkey % 4 < 3 then cast(o_orderdate as date) end as day,
        case o_orderkey % 3 when 0 then 1 when 1 then 0 end as flag, case o_orderkey % 4 when 0 then 4e0 when 1 then 4e0 when 2 then 5e0 end as score, case o_orderkey % 3 when 0 then 'critical' when 2 then 'low' end as priority from orders""",
    "cln7_keep_first": """select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as rn from lineitem) where rn = 1""",
    "cln6_plain_text": r"""select page_id, length(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*_`#~]', '', 'g'), '^\s+|\s+$', '', 'g'), '')) as n from pages""",
    "val3_amounts_zero": "select count(*) as value from customer where c_acctbal < 0",
    "val1_null_keys": "select 'null_pk' as check, 'customer' as key, count(*) filter (where c_custkey is null) as value from customer union all select 'null_pk', 'events', count(*) filter (where event_id is null or event_id % 10 = 0) from events",
    "stm2_sliding": """with w as (select ts, value, cast(unnest(generate_series(date_trunc('day', ts) - interval 6 day, date_trunc('day', ts), interval 1 day)) as date) as day from events)
        select day, count(*) as n, round(avg(value), 3) as mean, round(stddev_samp(value), 3) as std from w group by 1""",
    "ag13_tier_counts": f"""with t as (select customer_id, count(*) as n from usage_events where customer_id is not null and session_date >= date '{USAGE_REF}' - 90 group by 1)
        select case when n <= 4 then 'Dormant' when n <= 15 then 'Casual' when n <= 49 then 'Regular' else 'Power User' end as tier, count(*) as n from t group by 1""",
    "cln13_to_18_transactions": """select 't' || o_orderkey as transaction_id, cast(o_custkey as varchar) as customer_id, cast(o_orderdate as date) as transaction_date, o_orderkey % 1000 + 0.5e0 as amount, case when o_orderkey % 2 = 0 then 'USD' else 'EUR' end as currency,
        case when o_orderkey % 3 = 0 then 'completed' else 'failed' end as status, case when o_orderkey % 5 > 0 then 'card' else 'unknown' end as payment_method, case when o_orderkey % 4 = 0 then 1 else 0 end as was_negative from orders""",
    "cln8_to_17_usage": """select 'u' || event_id as usage_id, case when event_id % 7 > 0 then cast(user_id as varchar) end as customer_id, case event_id % 3 when 0 then 'dashboard' when 1 then 'analytics' else 'sandbox' end as feature_name,
        case when event_id % 50 > 5 then cast(event_id % 50 - 5 as double) end as session_duration_seconds, case when event_id % 11 = 0 then 20000e0 else cast(event_id % 9 as double) end as usage_count, case when event_id % 4 > 0 then 'web' else 'unknown' end as device,
        case when event_id % 50 <= 5 then 1 else 0 end as duration_invalid, case when event_id % 11 = 0 then 1 else 0 end as usage_count_outlier, case when event_id % 7 = 0 then 1 else 0 end as customer_id_missing from events""",
    "src5_calendar": f"""select cast(strftime(d, '%Y%m%d') as int) as date_id, d as full_date, cast(year(d) as int) as year, cast(quarter(d) as int) as quarter, cast(month(d) as int) as month, monthname(d) as month_name, cast(weekofyear(d) as int) as week_of_year,
        cast(day(d) as int) as day_of_month, cast(isodow(d) - 1 as int) as day_of_week, dayname(d) as day_name, case when isodow(d) >= 6 then 1 else 0 end as is_weekend, case when day(d) = 1 then 1 else 0 end as is_month_start,
        case when d = last_day(d) then 1 else 0 end as is_month_end, 'FQ' || quarter(d) || '-' || year(d) as fiscal_quarter from (select cast(unnest(generate_series(date '{FIRST}', date '{LAST}', interval 1 day)) as date) as d)""",
    "stm1_daily": "select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2",
    "stm3_sessions": """with l as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events)
        select user_id, cast(sum(fresh) as bigint) as sessions, count(*) as n from l group by 1""",
}


def _period_sql(bucket: str, spine: str) -> str:
    return f"""with o as (select {bucket} as period, sum(amount) as revenue from transactions where status = 'completed' and transaction_date between date '{FIRST}' and date '{LAST}' group by 1),
        p as ({spine}), f as (select p.period, coalesce(revenue, 0) as revenue from p left join o using (period)), g as (select *, lag(revenue) over (order by period) as prev from f)
        select period, cast(round(revenue, 2) as double) as revenue, case when prev > 0 then round(cast(revenue - prev as double) / cast(prev as double), 4) end as growth from g"""


ORACLE["rv1_revenue_monthly"] = _period_sql("last_day(transaction_date)", "select last_day(cast(unnest(generate_series(date_trunc('month', min(period)), max(period), interval 1 month)) as date)) as period from o")
ORACLE["rv1_revenue_weekly"] = _period_sql("cast(transaction_date + cast((7 - isodow(transaction_date)) as int) as date)", "select cast(unnest(generate_series(min(period), max(period), interval 7 days)) as date) as period from o")
ORACLE["rv1_revenue_daily"] = _period_sql("transaction_date", "select cast(unnest(generate_series(min(period), max(period), interval 1 day)) as date) as period from o")
_TIERS = G.RULES
ORACLE["gv1_classify"] = (
    "with q as (select conv_id, turn, case turn % 3 when 0 then 'please delete ' || text when 1 then 'export all ' || text else text end as q from conversations), r as (select conv_id, turn, case "
    + " ".join(f"when regexp_matches(q, '(?i){p}') then '{n}'" for n, w, _, p in _TIERS if w == "question")
    + " else 'DEFAULT_SAFE' end as rule from q) select conv_id, turn, case when rule = 'MUTATING_QUESTION' then 'blocked' when rule = 'DEFAULT_SAFE' then 'safe' else 'requires_review' end as classification, rule from r"
)


QUERIES |= tool_queries.QUERIES
ORACLE |= tool_queries.oracle(ORACLE)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return {k: oracle(v) for k, v in ORACLE.items()}
