"""Tools over the billing tables: parameters are checked, a metric or a segmentation is chosen by its name.

Each takes the tables by name (customers, transactions, subscriptions, tickets, usage_events, invoices) and returns
a dict; a name that is unknown or a number out of its range gives {"error": ...}.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import retrieval as R
from ledgerlake.plans import billing as B
from ledgerlake.plans import metrics as M

#: Table, filter, day and summed column (rows are counted where there is none) of each metric.
SERIES = {
    "transaction_volume": ("transactions", None, "transaction_date", None),
    "revenue": ("transactions", "status = 'completed'", "transaction_date", "amount"),
    "ticket_count": ("tickets", None, "created_at", None),
    "mrr": ("subscriptions", "status = 'active'", "start_date", "mrr"),
}
REVENUE_METRICS = ("mrr", "arr", "arpc", "growth_rate", "all")
ANOMALY_METHODS = ("zscore", "iqr", "rolling")
FORECAST_METRICS, FORECAST_METHODS = ("revenue", "mrr", "ticket_count"), ("linear", "exponential")
#: The column with the segment's name and the one that ranks customers.
SEGMENTS = {"rfm": ("segment", "rfm_total"), "churn_risk": ("risk", "risk_score"), "usage_tier": ("tier", "sessions"), "health_score": (None, "health_score")}


def _unknown(**given: tuple) -> dict | None:
    """An error for the first value that is not among those allowed, or not between two bounds."""
    for name, (value, allowed) in given.items():
        if isinstance(allowed, range):
            if not allowed.start <= value < allowed.stop:
                return {"error": f"{name} must be between {allowed.start} and {allowed.stop - 1}, not {value}"}
        elif value not in allowed:
            return {"error": f"unknown {name} '{value}'; one of {', '.join(allowed)}"}
    return None


def series(tables: dict[str, DataFrame], metric: str, by_month: bool = False, since=None) -> DataFrame:
    """period, value of a metric by day (mrr: by month of the start), rows before ``since`` left out."""
    table, only, day, amount = SERIES[metric]
    rows = tables[table].withColumn("_day", F.to_date(day)).where("_day is not null")
    rows = rows.where(only) if only else rows
    rows = rows.where(F.col("_day") >= since) if since is not None else rows
    period = F.trunc("_day", "MM") if by_month or metric == "mrr" else F.col("_day")
    value = F.round(B.money(amount), 2) if amount else F.count("*")
    return rows.groupBy(period.alias("period")).agg(value.cast("double").alias("value"))


def revenue_calculator(tables: dict[str, DataFrame], start: str, end: str, granularity: str = "monthly", metric: str = "all") -> dict:
    """TL2: ``series`` (period, revenue, growth) and ``recurring`` (of mrr, arr, arpc those asked for)."""
    wrong = _unknown(granularity=(granularity, M.BUCKETS), metric=(metric, REVENUE_METRICS))
    if wrong:
        return wrong
    out = {"metric": metric, "granularity": granularity}
    if metric in ("growth_rate", "all"):
        out["series"] = M.revenue(tables["transactions"], start, end, granularity)
    if metric != "growth_rate":
        recurring = M.recurring(tables["subscriptions"])
        out["recurring"] = recurring if metric == "all" else recurring.select(metric)
    return out


def segment_customers(tables: dict[str, DataFrame], kind: str, ref: str, top_n: int = 10, days: int = 30) -> dict:
    """TL3, SG1 to SG4: ``distribution`` (segment, n) and the ``top`` customers, ties to the smaller customer_id."""
    wrong = _unknown(segmentation_type=(kind, SEGMENTS), top_n=(top_n, range(1, 101)))
    if wrong:
        return wrong
    if kind == "rfm":
        found = M.rfm(tables["transactions"], ref)
    elif kind == "churn_risk":
        found = M.churn_risk(tables["customers"], tables["usage_events"], tables["tickets"], ref, days)
    elif kind == "usage_tier":
        found = M.usage_tier(tables["usage_events"], ref)
    else:
        found = B.health(*[tables[t] for t in ("customers", "transactions", "tickets", "usage_events", "invoices")])
    segment, by = SEGMENTS[kind]
    band = F.col(segment) if segment else F.concat((F.least(F.floor(F.col(by) / 20), F.lit(4)) * 20).cast("string"), F.lit("+"))
    return {"segmentation_type": kind, "distribution": found.groupBy(band.alias("segment")).agg(F.count("*").alias("n")), "top": found.orderBy(F.desc(by), "customer_id").limit(top_n)}


def find_anomalies(tables: dict[str, DataFrame], metric: str, ref: str, lookback_days: int = 90, sensitivity: float = 2.0, method: str = "zscore") -> dict:
    """TL4: ``anomalies`` (period, value, score, direction) of a metric."""
    wrong = _unknown(metric_name=(metric, SERIES), method=(method, ANOMALY_METHODS), lookback_days=(lookback_days, range(7, 366)))
    if wrong is None and not 0.5 <= sensitivity <= 5:
        wrong = {"error": f"sensitivity must be between 0.5 and 5, not {sensitivity}"}
    if wrong:
        return wrong
    points = series(tables, metric, since=F.date_sub(F.lit(ref).cast("date"), lookback_days))
    # the month in which the days begin counts, though its first day lies before them
    return {"metric": metric, "method": method, "anomalies": M.anomalies(points, ref, lookback_days + 31, sensitivity, method)}


def make_forecast(tables: dict[str, DataFrame], metric: str, horizon_days: int = 90, method: str = "linear") -> dict:
    """TL7: ``forecast`` (month, predicted, low, high) of a metric."""
    wrong = _unknown(metric_name=(metric, FORECAST_METRICS), method=(method, FORECAST_METHODS), forecast_horizon=(horizon_days, range(7, 366)))
    return wrong or {"metric": metric, "method": method, "forecast": M.forecast(series(tables, metric, by_month=True), horizon_days, method)}


def knowledge(docs: DataFrame, query: str, top_k: int = 3) -> dict:
    """TL5: ``passages`` of Markdown (source, text) rows with score and citation; where nothing fits, the first ones."""
    wrong = _unknown(top_k=(top_k, range(1, 9)))
    if wrong:
        return wrong
    chunks = R.chunk(docs, 600, 0)
    hits = R.keyword(chunks, query, top_k)
    if hits.isEmpty():
        hits = chunks.withColumn("score", F.lit(0.0)).orderBy("source", F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int")).limit(top_k)
    return {"query": query, "passages": hits.withColumn("citation", R.citation("source", "section"))}


def recent_revenue(transactions: DataFrame, ref: str, months: int = 12) -> DataFrame:
    """month, revenue of the completed transactions of the months before ``ref``."""
    end = F.lit(ref).cast("date")
    rows = transactions.where((F.col("status") == "completed") & F.col("transaction_date").between(F.add_months(end, -months), end))
    return rows.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month")).agg(B.double(B.money("amount")).alias("revenue"))
