"""Analytical plans over the billing star schema.

Each takes DataFrames and returns one.  Sums of money are decimal until the last
step, ratios guard their divisor, and ties have an explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_END = "2099-12-31"


def money(c) -> Column:
    return F.sum(F.col(c).cast("decimal(18,4)") if isinstance(c, str) else c)


def share(a: Column, b: Column, digits: int = 1) -> Column:
    return F.round(100.0 * a / F.nullif(b, F.lit(0)), digits)


def double(c: Column, digits: int = 2) -> Column:
    return F.round(c, digits).cast("double")


def ranked(df: DataFrame, score: str, name: str) -> DataFrame:
    """The dense rank of a score that is never null, largest first; one task orders the distinct scores only, not all rows."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(score))
    return df.join(df.select(score).distinct().withColumn(name, F.dense_rank().over(order)), score)


def _cohorts(customers: DataFrame, transactions: DataFrame, month: Column) -> DataFrame:
    base = customers.where("signup_date is not null").select("customer_id", "signup_date", F.date_format("signup_date", "yyyy-MM").alias("cohort_month"))
    base = base.withColumn("cohort_size", F.count("customer_id").over(W.partitionBy("cohort_month")))
    paid = transactions.where("status = 'completed' and transaction_date is not null").select("customer_id", "transaction_date", "amount")
    # one row for each customer and month first, so that distinct customers are plain counts
    both = base.join(paid, "customer_id").withColumn("m", month).withColumn("m", F.when(F.col("m").isin(1, 2, 3, 6, 12), F.col("m")))
    both = both.groupBy("cohort_month", "cohort_size", "customer_id", "m").agg(money("amount").alias("amount"))
    aggs = []
    for m in (1, 2, 3, 6, 12):
        aggs += [double(F.coalesce(F.sum(F.when(F.col("m") == m, F.col("amount"))), F.lit(0))).alias(f"rev_m{m}"), F.count_if(F.col("m") == m).alias(f"n_m{m}")]
    out = both.groupBy("cohort_month", "cohort_size").agg(*aggs)
    return out.select("cohort_month", "cohort_size", *[f"rev_m{m}" for m in (1, 2, 3, 6, 12)], *[share(F.col(f"n_m{m}"), F.col("cohort_size")).alias(f"ret_m{m}") for m in (1, 2, 3, 6, 12)]).orderBy("cohort_month")


def cohort(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Q1: revenue and retention of signup cohorts at months of 30.44 days, cut toward zero."""
    days = F.datediff(F.trunc("transaction_date", "MM"), F.trunc("signup_date", "MM"))
    return _cohorts(customers, transactions, (days / 30.44).cast("int") + 1)


def cohort_calendar(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Q1b: the same at calendar months, payments above zero only."""
    a, b = F.col("transaction_date"), F.col("signup_date")
    return _cohorts(customers, transactions.where("amount > 0"), (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b) + 1)


def waterfall(subscriptions: DataFrame, start: str, end: str, whole_months: bool = False) -> DataFrame:
    """Q2 (Q2b with ``whole_months``): recurring revenue by month and how it moved.

    Months come from each subscription's own sequence, so no range join is needed.
    Q2b counts the starting month from its first day and adds the running total.
    """
    s = subscriptions.where("status in ('active', 'cancelled', 'expired') and start_date is not null")
    first = F.trunc("start_date", "MM")
    low = F.lit(start).cast("date")
    if not whole_months:
        first = F.when(F.col("start_date") > first, F.add_months(first, 1)).otherwise(first)
    last = F.trunc(F.least(F.coalesce("end_date", F.lit(OPEN_END).cast("date")), F.lit(end).cast("date")), "MM")
    s = s.select("customer_id", "mrr", F.greatest(first, F.trunc(low, "MM")).alias("a"), last.alias("b")).where("a <= b")
    by = s.select("customer_id", "mrr", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).groupBy("customer_id", "month").agg(money("mrr").alias("mrr"))
    prev = F.coalesce(F.lag("mrr").over(W.partitionBy("customer_id").orderBy("month")), F.lit(0))
    moved = by.withColumn("prev", prev).withColumn("delta", F.col("mrr") - F.col("prev"))
    kind = F.when((F.col("prev") == 0) & (F.col("mrr") > 0), "new").when((F.col("mrr") == 0) & (F.col("prev") > 0), "churned").when(F.col("delta") > 0, "expansion").when(F.col("delta") < 0, "contraction").otherwise("unchanged")
    moved = moved.withColumn("kind", kind).where("kind <> 'unchanged'")
    part = lambda k: double(F.sum(F.when(F.col("kind") == k, F.col("delta")).otherwise(0))).alias(f"{k}_mrr")
    out = moved.groupBy("month").agg(*[part(k) for k in ("new", "expansion", "contraction", "churned")], F.sum("delta").alias("net"))
    cols = [F.date_format("month", "yyyy-MM").alias("month"), "new_mrr", "expansion_mrr", "contraction_mrr", "churned_mrr", double(F.col("net")).alias("net_new_mrr")]
    if whole_months:
        cols.append(double(F.sum("net").over(W.partitionBy(F.lit(0)).orderBy("month").rowsBetween(W.unboundedPreceding, 0))).alias("cumulative_mrr"))
    return out.select(*cols).orderBy("month")


def health(customers: DataFrame, transactions: DataFrame, tickets: DataFrame, usage: DataFrame, invoices: DataFrame, recent_days: int = 90) -> DataFrame:
    """Q3: weighted score of recency, support, usage and payment for active customers."""
    active = customers.where("is_active = 1").select("customer_id")
    ref = transactions.agg(F.max("transaction_date").alias("ref"))
    last = transactions.where("status = 'completed'").groupBy("customer_id").agg(F.max("transaction_date").alias("last"))
    days = F.datediff("ref", "last")
    recency = last.crossJoin(F.broadcast(ref)).select("customer_id", F.when(days.isNotNull(), F.round(F.greatest(F.lit(0.0), 100 - days / 180.0 * 100), 2)).alias("recency_score"))
    support = tickets.groupBy("customer_id").agg(F.count("ticket_id").alias("n_t"), F.avg("rating").alias("r_t"))
    seen = usage.agg(F.max("session_date").alias("ref"))
    used = usage.crossJoin(F.broadcast(seen)).where(F.col("session_date") >= F.date_sub("ref", recent_days)).groupBy("customer_id").agg(F.count("usage_id").alias("n_u"), F.countDistinct("feature_name").alias("f_u"))
    paid = invoices.groupBy("customer_id").agg(F.count_if((F.col("paid_date") <= F.col("due_date")) & (F.col("payment_status") == "paid")).alias("on_time"), F.count("due_date").alias("due"))
    all_ = active.join(recency, "customer_id", "left").join(support, "customer_id", "left").join(used, "customer_id", "left").join(paid, "customer_id", "left")
    n_t, n_u, f_u = (F.coalesce(c, F.lit(0)) for c in ("n_t", "n_u", "f_u"))
    all_ = all_.withColumns(
        {
            "support_score": F.round(F.greatest(F.lit(0), 100 - n_t * 5) * 0.5 + F.coalesce("r_t", F.lit(3.0)) / 5.0 * 100 * 0.5, 2),
            "usage_score": F.round(F.least(n_u / 12.86 * 10, F.lit(100.0)) * 0.6 + F.least(f_u * 10.0, F.lit(100.0)) * 0.4, 2),
            "payment_score": F.round(100.0 * F.col("on_time") / F.nullif("due", F.lit(0)), 2),
        }
    )
    # the parts have two decimals, so their weighted sum is exact in decimals
    weights = {"recency_score": "0.30", "support_score": "0.25", "usage_score": "0.25", "payment_score": "0.20"}
    raw = sum((F.coalesce(c, F.lit(50.0)).cast("decimal(10,2)") * F.lit(w).cast("decimal(4,2)") for c, w in weights.items()), F.lit(0).cast("decimal(10,4)"))
    return ranked(all_.withColumn("raw", raw), "raw", "health_rank").select("customer_id", *[F.coalesce(c, F.lit(50.0)).alias(c) for c in weights], double(F.col("raw")).alias("health_score"), "health_rank")


def double_billing(subscriptions: DataFrame) -> DataFrame:
    """Q4: overlapping subscriptions of a customer and what is billed twice, with a running total."""
    s = subscriptions.where("start_date is not null").withColumn("end_date", F.coalesce("end_date", F.lit(OPEN_END).cast("date")))
    s = s.withColumn("rn", F.row_number().over(W.partitionBy("customer_id").orderBy("start_date", "subscription_id"))).select("customer_id", "subscription_id", "start_date", "end_date", "mrr", "rn")
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, (F.col("a.customer_id") == F.col("b.customer_id")) & (F.col("a.rn") < F.col("b.rn")) & (F.col("b.start_date") < F.col("a.end_date")) & (F.col("b.start_date") >= F.col("a.start_date")))
    days = F.datediff(F.least("a.end_date", "b.end_date"), F.col("b.start_date"))
    amount = F.round(F.least("a.mrr", "b.mrr").cast("decimal(18,2)") * days / 30, 2)
    out = pairs.select("a.customer_id", F.col("a.subscription_id").alias("sub_a"), F.col("b.subscription_id").alias("sub_b"), F.col("b.start_date").alias("start_b"), days.alias("overlap_days"), amount.alias("amount")).where("overlap_days > 0")
    total = F.sum("amount").over(W.partitionBy("customer_id").orderBy("start_b"))
    return out.select("customer_id", "sub_a", "sub_b", "start_b", "overlap_days", F.col("amount").cast("double").alias("double_billed"), total.cast("double").alias("running_double_billed"))


def ticket_funnel(tickets: DataFrame) -> DataFrame:
    """Q5: response and resolution percentiles by priority (buckets of NTILE 100, ties by ticket_id)."""
    hours = lambda a: F.round((F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9, 2)
    t = tickets.where("created_at is not null").withColumns({"response_hours": hours("first_response_at"), "resolution_hours": hours("resolved_at")}).where("resolution_hours > 0")
    by = lambda c: F.ntile(100).over(W.partitionBy("priority").orderBy(F.asc_nulls_first(c), "ticket_id"))
    t = t.withColumns({"a": by("response_hours"), "b": by("resolution_hours")})
    mid = t.groupBy("priority").agg(F.avg(F.when(F.col("b") == 50, F.col("resolution_hours"))).alias("p50"))
    done = F.col("status").isin("closed", "resolved")
    out = t.join(mid, "priority").groupBy("priority").agg(
        F.count("ticket_id").alias("total_tickets"), F.round(F.avg(F.when(F.col("a") == 50, F.col("response_hours"))), 2).alias("p50_response_hours"), F.round(F.first("p50"), 2).alias("p50_resolution_hours"),
        F.round(F.avg(F.when(F.col("b") >= 95, F.col("resolution_hours"))), 2).alias("p95_resolution_hours"), share(F.count_if(done & (F.col("is_escalated") == 0)), F.count_if(done)).alias("fcr_rate_pct"),
        share(F.count_if(F.col("is_escalated") == 1), F.count("ticket_id")).alias("escalation_rate_pct"), F.count_if(F.col("resolution_hours") > 2 * F.col("p50")).alias("outlier_tickets"), F.round(F.avg("resolution_hours"), 2).alias("avg_resolution_hours"),
    )
    rank = F.when(F.col("priority") == "critical", 1).when(F.col("priority") == "high", 2).when(F.col("priority") == "medium", 3).when(F.col("priority") == "low", 4).otherwise(5)
    return out.orderBy(rank, "priority")


def pareto(transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """Q6: revenue concentration; the running share is a window, not a recursion."""
    per = transactions.where("status = 'completed'").join(customers.select("customer_id", "name"), "customer_id").groupBy("customer_id", "name").agg(F.round(money("amount"), 2).alias("rev"))
    every, order = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.desc("rev"), "customer_id")
    # whole numbers, as a quotient of decimals would be rounded twice
    cents = (F.col("rev") * 100).cast("decimal(24,0)")
    per = per.withColumns({"_c": cents, "revenue_rank": F.row_number().over(order)}).withColumn("_total", F.nullif(F.sum("_c").over(every), F.lit(0)))
    pct = (F.expr("(_c * cast(2000000 as decimal(7,0)) + _total) div (2 * _total)") / 10000).cast("decimal(18,4)")
    per = per.withColumn("pct", pct)
    per = per.withColumns({"cum": F.sum("pct").over(order.rowsBetween(W.unboundedPreceding, 0)), "h": F.sum(F.col("pct").cast("double") * F.col("pct").cast("double")).over(every)})
    segment = F.when(F.col("cum") <= 50, "Top 50%").when(F.col("cum") <= 80, "Top 80%").when(F.col("cum") <= 90, "Top 90%").otherwise("Tail")
    return per.select("customer_id", "name", F.col("rev").cast("double").alias("total_revenue"), F.col("pct").cast("double").alias("revenue_pct"), "revenue_rank", F.col("cum").cast("double").alias("cumulative_pct"), segment.alias("segment"), (F.col("pct") > 5).cast("int").alias("concentration_flag"), F.round(F.col("h") / 100, 2).alias("hhi"))


def feature_funnel(usage: DataFrame, recent_days: int = 30) -> DataFrame:
    """Q7: how many customers reach, return to and rely on each feature."""
    ref = usage.agg(F.max("session_date").alias("ref"))
    per = usage.crossJoin(F.broadcast(ref)).where("customer_id is not null").groupBy("feature_name", "customer_id").agg(F.count("*").alias("n"), F.count_if(F.col("session_date") >= F.date_sub("ref", recent_days)).alias("recent"))
    who = F.col("customer_id")
    n = F.countDistinct(who)
    active, power = F.countDistinct(F.when(F.col("n") > 1, who)), F.countDistinct(F.when(F.col("recent") >= 5, who))
    return per.groupBy("feature_name").agg(n.alias("reached"), active.alias("activated"), power.alias("power_users"), share(active, n).alias("activation_rate"), share(power, n).alias("power_rate"), F.round(F.avg("n"), 2).alias("avg_sessions"), F.round(F.avg("recent"), 2).alias("avg_recent_sessions")).orderBy("activation_rate", "feature_name")


def churn_signals(customers: DataFrame, usage: DataFrame, tickets: DataFrame, days: int = 30, login_days: int = 14, top: int | None = 50, usage_ref: str | None = None, ticket_ref: str | None = None) -> DataFrame:
    """Q8: four signals of churn for active customers, ranked."""
    ref = (lambda df, c, fixed: df.agg(F.max(c).alias("ref")) if fixed is None else df.sparkSession.range(1).select(F.lit(fixed).cast("date").alias("ref")))
    u = usage.where("customer_id is not null").crossJoin(F.broadcast(ref(usage, "session_date", usage_ref)))
    now, before = F.col("session_date") >= F.date_sub("ref", days), (F.col("session_date") >= F.date_sub("ref", 2 * days)) & (F.col("session_date") < F.date_sub("ref", days))
    u = u.groupBy("customer_id").agg((F.count_if(now) < F.count_if(before)).cast("int").alias("usage_decline"), (F.max("session_date") < F.date_sub(F.max("ref"), login_days)).cast("int").alias("no_recent_login"))
    t = tickets.crossJoin(F.broadcast(ref(tickets, F.to_date("created_at"), ticket_ref)))
    fresh = F.to_date("created_at") >= F.date_sub("ref", days)
    t = t.groupBy("customer_id").agg(
        ((F.count_if(fresh) > F.count("ticket_id") / 6.0 * 1.5) & (F.count_if(fresh) > 0)).cast("int").alias("ticket_spike"), F.coalesce((F.avg(F.when(fresh, F.col("rating"))) < F.avg("rating")).cast("int"), F.lit(0)).alias("rating_drop")
    )
    c = customers.where("is_active = 1").select("customer_id", "name").join(u, "customer_id", "left").join(t, "customer_id", "left")
    parts = {"usage_decline": 0, "ticket_spike": 0, "rating_drop": 0, "no_recent_login": 1}
    c = c.select("customer_id", "name", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in parts.items()])
    c = c.withColumn("churn_score", sum((F.col(k) for k in parts), F.lit(0)))
    c = ranked(c, "churn_score", "churn_rank").select(*c.columns, "churn_rank")
    return c.orderBy(F.desc("churn_score"), "customer_id").limit(top) if top else c


def dashboard(customers: DataFrame, subscriptions: DataFrame, tickets: DataFrame) -> DataFrame:
    """DB1: one row of key figures."""
    mrr = subscriptions.agg(F.coalesce(money(F.when(F.col("status") == "active", F.col("mrr").cast("decimal(18,4)"))), F.lit(0)).alias("m"), share(F.countDistinct(F.when(F.col("status") == "cancelled", F.col("customer_id"))), F.countDistinct("customer_id"), 2).alias("churn_rate_pct"))
    hours = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9
    t = tickets.agg(F.round(F.avg(hours), 2).alias("avg_resolution_hours"), F.round((F.avg("rating") - 3) / 2 * 100, 1).alias("nps_proxy"))
    one = mrr.crossJoin(customers.agg(F.count_if(F.col("is_active") == 1).alias("active_customers"))).crossJoin(t)
    return one.select(double(F.col("m")).alias("mrr"), double(F.col("m") * 12).alias("arr"), "active_customers", "churn_rate_pct", "avg_resolution_hours", "nps_proxy")
