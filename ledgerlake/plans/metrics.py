"""Revenue series, segments, anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import billing as B

BUCKETS = {"daily": lambda d: d, "weekly": lambda d: F.next_day(F.date_sub(d, 1), "SUN"), "monthly": F.last_day}
STEPS = {"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month"}


def revenue(transactions: DataFrame, start: str, end: str, granularity: str = "monthly") -> DataFrame:
    """RV1: completed revenue by day, week (to Sunday) or month end; empty buckets are 0; growth over the bucket before."""
    t = transactions.where((F.col("status") == "completed") & F.col("transaction_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    own = t.groupBy(BUCKETS[granularity](F.col("transaction_date")).alias("period")).agg(B.money("amount").alias("revenue"))
    spine = own.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(F.explode(F.sequence(F.trunc("a", "MM") if granularity == "monthly" else F.col("a"), "b", F.expr(STEPS[granularity]))).alias("p"))
    spine = spine.select((F.last_day("p") if granularity == "monthly" else F.col("p")).alias("period"))
    full = spine.join(own, "period", "left").select("period", F.coalesce("revenue", F.lit(0)).alias("revenue"))
    prev = F.lag("revenue").over(W.partitionBy(F.lit(0)).orderBy("period"))
    return full.select("period", B.double(F.col("revenue")).alias("revenue"), F.when(prev > 0, F.round((F.col("revenue") - prev).cast("double") / prev.cast("double"), 4)).alias("growth"))


def recurring(subscriptions: DataFrame) -> DataFrame:
    """RV1: mrr, arr and mrr per active customer."""
    a = subscriptions.where("status = 'active'").agg(B.money("mrr").alias("m"), F.countDistinct("customer_id").alias("n"))
    return a.select(B.double(F.col("m")).alias("mrr"), B.double(F.col("m") * 12).alias("arr"), F.round(F.col("m").cast("double") / F.nullif("n", F.lit(0)), 2).alias("arpc"))


def _fifth(order) -> Column:
    """Quintile of a row number with linear edges: not NTILE; a lone row gets 3."""
    every = W.partitionBy(F.lit(0))
    rn, n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)), F.count("*").over(every)
    return F.when(n == 1, 3).otherwise(F.greatest(F.lit(1), F.ceil((rn - 1) * 5 / F.nullif(n - 1, F.lit(0))))).cast("int")


def rfm(transactions: DataFrame, ref: str) -> DataFrame:
    """SG1: recency, frequency and monetary quintiles and the segment of their sum."""
    per = transactions.where("status = 'completed' and transaction_date is not null").groupBy("customer_id").agg(F.datediff(F.lit(ref).cast("date"), F.max("transaction_date")).alias("recency"), F.count("amount").alias("frequency"), F.round(B.money("amount"), 2).alias("monetary"))
    per = per.withColumns({"r": 6 - _fifth(("recency", "customer_id")), "f": _fifth(("frequency", "customer_id")), "m": _fifth(("monetary", "customer_id"))})
    total = F.col("r") + F.col("f") + F.col("m")
    segment = F.when(total <= 5, "Hibernating").when(total <= 8, "At Risk").when(total <= 10, "Needs Attention").when(total <= 12, "Loyal").otherwise("Champions")
    return per.select("customer_id", "recency", "frequency", F.col("monetary").cast("double").alias("monetary"), "r", "f", "m", total.alias("rfm_total"), segment.alias("segment"))


def churn_risk(customers: DataFrame, usage: DataFrame, tickets: DataFrame, ref: str, days: int = 30) -> DataFrame:
    """SG2: three signals against a fixed date."""
    c = B.churn_signals(customers, usage, tickets, days, top=None, usage_ref=ref, ticket_ref=ref)
    score = F.col("usage_decline") + F.col("ticket_spike") + F.col("no_recent_login")
    return c.select("customer_id", score.alias("risk_score"), F.when(score == 0, "Healthy").when(score == 1, "Low").when(score == 2, "Medium").otherwise("High").alias("risk"))


def usage_tier(usage: DataFrame, ref: str, days: int = 90) -> DataFrame:
    """SG3: sessions of the last days, in right-closed bins."""
    per = usage.where(F.col("customer_id").isNotNull() & (F.col("session_date") >= F.date_sub(F.lit(ref).cast("date"), days))).groupBy("customer_id").agg(F.count("*").alias("sessions"), F.countDistinct("feature_name").alias("features"))
    n = F.col("sessions")
    return per.select("customer_id", "sessions", "features", F.when(n <= 4, "Dormant").when(n <= 15, "Casual").when(n <= 49, "Regular").when(n <= 9999, "Power User").alias("tier"))


def distribution(segments: DataFrame, column: str = "segment") -> DataFrame:
    return segments.groupBy(column).count()


def anomalies(series: DataFrame, ref: str, lookback: int = 90, sensitivity: float = 2.0, method: str = "zscore") -> DataFrame:
    """AN1: points (period, value) away from the mean, outside the quartiles, or away from seven rolling rows."""
    s = series.where(F.col("period") >= F.date_sub(F.lit(ref).cast("date"), lookback))
    every = W.partitionBy(F.lit(0))
    s = s.withColumns({"n": F.count("*").over(every), "mu": F.avg("value").over(every), "sd": F.stddev_pop("value").over(every)}).where("n >= 3")
    if method == "zscore":
        score = F.abs(F.col("value") - F.col("mu")) / (F.col("sd") + 1e-9)
        hit = score > sensitivity
    elif method == "iqr":
        s = s.withColumn("q", F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(every))
        iqr = F.col("q")[1] - F.col("q")[0]
        score = F.abs(F.col("value") - F.col("mu")) / (iqr + 1e-9)
        hit = (F.col("value") < F.col("q")[0] - sensitivity * iqr) | (F.col("value") > F.col("q")[1] + sensitivity * iqr)
    else:
        last = W.partitionBy(F.lit(0)).orderBy("period").rowsBetween(-6, 0)
        score = F.abs(F.col("value") - F.avg("value").over(last)) / (F.coalesce(F.stddev_samp("value").over(last), F.lit(1.0)) + 1e-9)
        hit = score > sensitivity
    s = s.withColumns({"score": score, "hit": hit})
    return s.where("hit").select("period", F.round("value", 2).alias("value"), F.round("score", 3).alias("score"), F.when(F.col("value") > F.col("mu"), "spike").otherwise("drop").alias("direction"))


def forecast(series: DataFrame, horizon_days: int = 90, method: str = "linear", alpha: float = 0.3) -> DataFrame:
    """FC1: months ahead of a series (period, value) with 95 per cent bounds; none for fewer than three periods."""
    months = max(1, horizon_days // 30)
    s = series.where("period is not null")
    fold = F.array_sort(F.collect_list(F.struct("period", F.col("value").cast("double").alias("value"))))
    one = s.agg(fold.alias("s"), F.max("period").alias("last")).where(F.size("s") >= 3)
    if method == "linear":
        p = one.select("last", F.posexplode("s").alias("x", "v"), F.size("s").alias("n"))
        fit = p.groupBy("last", "n").agg(F.regr_slope(F.col("v.value"), F.col("x")).alias("slope"), F.regr_intercept(F.col("v.value"), F.col("x")).alias("base"))
        rest = p.join(fit, ["last", "n"]).groupBy("last", "n", "slope", "base").agg((1.96 * F.stddev_pop(F.col("v.value") - (F.col("slope") * F.col("x") + F.col("base")))).alias("ci"))
        value = F.col("slope") * (F.col("n") + F.col("i") - 1) + F.col("base")
    else:
        start = F.struct(F.col("s")[0]["value"].alias("level"), F.array().cast("array<double>").alias("off"))
        step = lambda a, x: F.struct((alpha * x["value"] + (1 - alpha) * a["level"]).alias("level"), F.array_append(a["off"], alpha * x["value"] + (1 - alpha) * a["level"] - x["value"]).alias("off"))
        rest = one.select("last", F.aggregate("s", start, step).alias("a")).select("last", F.col("a.level").alias("level"), F.explode("a.off").alias("off")).groupBy("last", "level").agg((1.96 * F.stddev_pop("off")).alias("ci"))
        value = F.col("level")
    out = rest.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(months))))
    return out.select(F.date_format(F.add_months(F.trunc("last", "MM"), F.col("i")), "yyyy-MM").alias("month"), F.round(value, 2).alias("predicted"), F.round(value - F.col("ci"), 2).alias("low"), F.round(value + F.col("ci"), 2).alias("high"))
