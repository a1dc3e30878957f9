"""Profiles and integrity checks as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """column, n_rows, n_null, n_unique, numeric share, mean, std (sample), min, median, max, top five values."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    v = F.expr("try_cast(value as double)")
    stats = cells.groupBy("column").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"), F.countDistinct("value").alias("n_unique"), F.try_divide(F.count(v), F.count("value")).alias("numeric_share"),
        F.bround(F.avg(v), 4).alias("mean"), F.bround(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("min"), F.percentile(v, 0.5).alias("median"), F.max(v).alias("max"),
    )
    tops = cells.where("value is not null").groupBy("column", "value").count()
    tops = tops.withColumn("_rn", F.row_number().over(W.partitionBy("column").orderBy(F.desc("count"), "value"))).where("_rn <= 5")
    tops = tops.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("_rn", "value", "count"))).alias("_t")).select("column", F.transform("_t", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("top_values"))
    return stats.join(tops, "column", "left")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """duplicate_rows, duplicate_keys."""
    rows = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    return rows.crossJoin(df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_keys")))


def null_keys(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count_if(F.col(keys[n]).isNull()).alias("value")).select(F.lit("null_pk").alias("check"), F.lit(n).alias("key"), "value") for n, df in tables.items()])


def require_keys(tables: dict[str, DataFrame], keys: dict[str, str]) -> None:
    """Raises if any primary key is null."""
    bad = null_keys(tables, keys).where("value > 0").collect()
    if bad:
        raise ValueError("null primary keys: " + ", ".join(f"{r['key']} {r['value']}" for r in bad))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """value: rows whose non-null key the parent lacks; sample: five such keys."""
    lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    keys = lost.select(key).distinct().orderBy(key).limit(5).agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return lost.agg(F.count("*").alias("value")).crossJoin(keys)


def non_positive(df: DataFrame, column: str, allow_zero: bool = False) -> DataFrame:
    return df.agg(F.count_if(F.col(column) < 0 if allow_zero else F.col(column) <= 0).alias("value"))


def null_dates(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("value"), F.bround(F.try_divide(100.0 * F.count_if(F.col(column).isNull()), F.count("*")), 2).alias("pct"))


def overlaps(subs: DataFrame, statuses: tuple[str, ...] = ("active", "paused"), limit: int = 20) -> DataFrame:
    """The first overlapping pairs of subscriptions of one customer (a report, so it has a limit)."""
    s = subs.where(F.col("status").isin(*statuses) & F.col("start_date").isNotNull()).withColumn("end_date", F.coalesce("end_date", F.lit("2099-12-31").cast("date")))
    a, b = s.alias("a"), s.alias("b")
    later = (F.col("b.start_date") > F.col("a.start_date")) | ((F.col("b.start_date") == F.col("a.start_date")) & (F.col("b.subscription_id") > F.col("a.subscription_id")))
    pairs = a.join(b, (F.col("a.customer_id") == F.col("b.customer_id")) & later & (F.col("b.start_date") < F.col("a.end_date")))
    days = F.greatest(F.datediff(F.least("a.end_date", "b.end_date"), F.col("b.start_date")), F.lit(0))
    return pairs.select("a.customer_id", F.col("a.subscription_id").alias("first_id"), F.col("b.subscription_id").alias("second_id"), days.alias("days")).orderBy("customer_id", "first_id", "second_id").limit(limit)


def report(checks: DataFrame) -> DataFrame:
    """check, key, value, status, sample, note: PASS, WARN, (null keys) FAIL or (what has a note) INFO."""
    more = {c: F.lit(None).cast("string") for c in ("sample", "note") if c not in checks.columns}
    checks = checks.withColumns(more) if more else checks
    status = F.when(F.length("note") > 0, "INFO").when(F.col("value") == 0, "PASS").when(F.col("check") == "null_pk", "FAIL").otherwise("WARN")
    return checks.select("check", "key", "value", status.alias("status"), "sample", "note")
