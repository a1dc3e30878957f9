"""Cleaning recipes for the six raw tables, key deduplication and the summary of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.functions import cleaning as C

#: Spellings of priorities, plans and features that are one.
PRIORITIES = {"crit": "critical", "hi": "high", "lo": "low", "med": "medium"}
PLANS = {
    "pro": "pro", "professional": "pro", "basic": "basic", "starter": "basic", "scale": "scale",
    "growth": "growth", "enterprise": "enterprise", "premium": "enterprise", "free": "free",
}
FEATURES = {
    "dashbord": "dashboard", "analytic": "analytics", "custome_reports": "custom_reports", "custm_reports": "custom_reports", "integartion": "integration", "integrtion": "integration",
    "repoting": "reporting", "reportng": "reporting", "sandox": "sandbox", "sndbx": "sandbox", "exprots": "exports", "exprt": "exports",
}
#: What stands for a missing value, and the keys of the tables.
FILL = {"loyalty_tier": "unknown", "company": "Unknown", "payment_method": "unknown", "category": "uncategorized", "channel": "unknown", "agent_name": "unassigned", "resolution_text": "", "device": "unknown", "plan_name": "unknown"}
KEYS = {"customers": "customer_id", "transactions": "transaction_id", "subscriptions": "subscription_id", "invoices": "invoice_id", "support_tickets": "ticket_id", "product_usage": "usage_id"}
CLEANERS = {
    C.currency: "amount mrr subtotal tax total paid_amount",
    C.date: "signup_date transaction_date start_date end_date issue_date due_date paid_date created_at first_response_at resolved_at session_date",
    C.category: "loyalty_tier status payment_method plan_name billing_cycle payment_status category priority channel device feature_name",
    C.boolean: "is_active auto_renew is_escalated",
    C.rating: "rating",
    C.plain_text: "resolution_text",
    C.number: "session_duration_seconds usage_count",
}


def keep_first(df: DataFrame, key: str, order: str | Column = "_ordinal") -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")


def typed(df: DataFrame) -> DataFrame:
    """Every known column through its cleaner."""
    of = {c: f for f, names in CLEANERS.items() for c in names.split()}
    return df.select(*[(of[c](F.col(c)) if c in of else C.text_or_null(F.col(c).cast("string"))).alias(c) for c in df.columns])


def clean(name: str, raw: DataFrame, today: str | None = None) -> DataFrame:
    """A raw table cleaned: deduplicated on its key, typed, filled, with its quality flags."""
    key = KEYS[name]
    df = raw.withColumn("_ordinal", F.monotonically_increasing_id())  # the place in the scan, before any shuffle
    if name == "product_usage":
        df = df.groupBy(*raw.columns).agg(F.min("_ordinal").alias("_ordinal"))
    df = keep_first(df, key).drop("_ordinal")
    df = typed(df)
    has = set(df.columns)
    now = F.lit(today).cast("date") if today else F.current_date()
    add: dict[str, Column] = {}
    if name == "customers":
        add |= {f"{c}_missing": C.flag(F.col(c).isNull()) for c in ("email", "phone") if c in has}
    if name == "transactions":
        add |= {"was_negative": C.flag(F.col("amount") < 0), "amount": F.abs("amount")}
    if name == "subscriptions":
        add |= {"mrr_was_negative": C.flag(F.col("mrr") < 0), "mrr": F.abs("mrr"), "is_future_start": C.flag(F.col("start_date") > now), "plan_name": C.canonical(F.col("plan_name"), PLANS)}
    if name == "invoices":
        rate = F.try_divide("tax", F.nullif("subtotal", F.lit(0.0)))
        add |= {"tax_rate": rate, "tax_error_flag": C.flag((rate < 0) | (rate > 0.5)), "paid_amount": F.coalesce("paid_amount", F.lit(0.0))}
    if name == "support_tickets":
        add |= {"priority": C.canonical(F.col("priority"), PRIORITIES)}
    if name == "product_usage":
        add |= {
            "duration_invalid": C.flag(F.col("session_duration_seconds") <= 0), "session_duration_seconds": F.when(F.col("session_duration_seconds") > 0, F.col("session_duration_seconds")),
            "usage_count_outlier": C.flag(F.col("usage_count") > 10000), "customer_id_missing": C.flag(F.col("customer_id").isNull()), "feature_name": C.canonical(F.col("feature_name"), FEATURES),
        }
    if "currency" in has:
        add["currency"] = F.upper("currency")
    df = df.withColumns(add)
    return df.na.fill({c: v for c, v in FILL.items() if c in has})


def clean_all(raw: dict[str, DataFrame], today: str | None = None) -> dict[str, DataFrame]:
    return {n: clean(n, df, today) for n, df in raw.items()}


def summary(raw: dict[str, DataFrame], cleaned: dict[str, DataFrame]) -> DataFrame:
    """table_name, raw_rows, clean_rows, removed, the sum of each table's flags, and null_rates by column."""
    rows = []
    for n, df in cleaned.items():
        flags = [c for c in df.columns if c.endswith(("_missing", "_invalid", "_outlier", "_flag", "was_negative", "is_future_start"))]
        total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(c), F.lit(0)) for c in flags], F.lit(0)).cast("long")
        rows.append(raw[n].agg(F.count("*").alias("raw_rows")).crossJoin(df.agg(F.count("*").alias("clean_rows"), total.alias("flagged"), F.create_map(*[x for c in df.columns for x in (F.lit(c), F.avg(F.col(c).isNull().cast("int")))]).alias("null_rates"))).select(F.lit(n).alias("table_name"), "raw_rows", "clean_rows", (F.col("raw_rows") - F.col("clean_rows")).alias("removed"), "flagged", "null_rates"))
    return reduce(DataFrame.unionByName, rows)
