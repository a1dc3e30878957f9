"""Scans: all-string CSV, nested customer JSON, calendar, Markdown, vector index, labelled SQL scripts."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_TABLES = ("transactions", "invoices", "subscriptions", "support_tickets", "product_usage")
#: Texts that count as missing in CSV input.
NA = ("", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "#N/A", "<NA>")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string; the reader strips a byte-order mark."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*NA), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """Nested name and address flattened to columns, all strings."""
    df = spark.read.option("multiLine", True).json(path)
    flat = {"name.first": "first_name", "name.last": "last_name", "address.city": "city", "address.country": "country", "address.zip": "zip_code"}
    own = [c for c in df.columns if c not in ("name", "address")]
    return df.select(*[F.col(c).cast("string").alias(c) for c in own], *[F.col(k).cast("string").alias(v) for k, v in flat.items()])


def ingest(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six raw tables, each also a temporary view raw_<name>."""
    raw = {t: read_csv(spark, f"{folder}/{t}.csv") for t in CSV_TABLES} | {"customers": read_customers(spark, f"{folder}/customers.json")}
    for name, df in raw.items():
        df.createOrReplaceTempView(f"raw_{name}")
    return raw


def calendar(spark: SparkSession, start: str = "2021-01-01", end: str = "2026-12-31") -> DataFrame:
    """One row a day; weeks are ISO weeks, Monday is day 0."""
    d = F.col("full_date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date"))
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_id"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("week_of_year"), F.dayofmonth(d).alias("day_of_month"), F.weekday(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(d) == 1).cast("int").alias("is_month_start"), (d == F.last_day(d)).cast("int").alias("is_month_end"), F.concat(F.lit("FQ"), F.quarter(d), F.lit("-"), F.year(d)).alias("fiscal_quarter"),
    )


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """source (file name), text (whole file) by source; a folder without Markdown is an error."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text")).orderBy("source")
    if found.isEmpty():
        raise FileNotFoundError(f"no Markdown in {folder}")
    return found


def labelled_sql(text: str) -> dict[str, str]:
    """{Q1: sql, ...} of a script whose parts begin with lines ``-- Q<digit>``."""
    parts = re.split(r"(?m)^--\s*(Q\d+)\b.*$", text)
    return {k: v.strip().rstrip(";").strip() for k, v in zip(parts[1::2], parts[2::2])}


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """None where there is no index."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """SQL with bound parameters."""
    return spark.sql(sql, args=args)
