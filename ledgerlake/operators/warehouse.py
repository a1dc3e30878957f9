"""Sinks: the typed star schema as Parquet, reports as CSV, the vector index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.quality import null_keys, orphans
from ledgerlake.operators.tables import FILL, KEYS
from ledgerlake.sources.readers import calendar
from ledgerlake.sources.schemas import SCHEMAS

#: (child, column, parent)
REFERENCES = (
    ("subscriptions", "customer_id", "customers"), ("transactions", "customer_id", "customers"), ("transactions", "subscription_id", "subscriptions"), ("invoices", "customer_id", "customers"),
    ("invoices", "subscription_id", "subscriptions"), ("support_tickets", "customer_id", "customers"), ("product_usage", "customer_id", "customers"),
)


#: What no row may be.
CONSTRAINTS = (
    ("transactions", "amount < 0"), ("invoices", "total < 0"), ("subscriptions", "mrr < 0"), ("support_tickets", "rating < 1 or rating > 5"), ("date_dim", "quarter not between 1 and 4"), ("date_dim", "month not between 1 and 12"),
)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table's schema, in its order and types; missing ones are null or what stands for a missing value."""
    columns = []
    for f in SCHEMAS[name]:
        value = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(FILL.get(f.name)).cast(f.dataType)
        columns.append(value.alias(f.name))
    return df.select(*columns)


def load(spark: SparkSession, cleaned: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Every table overwritten under ``folder`` and read again, the calendar included; rows without a key go to quarantine_<name>."""
    tables = dict(cleaned) | {"date_dim": calendar(spark)}
    for name, df in tables.items():
        if name in KEYS:
            df.where(F.col(KEYS[name]).isNull()).write.mode("overwrite").parquet(f"{folder}/quarantine_{name}")
            df = df.where(F.col(KEYS[name]).isNotNull())
        (conform(df, name) if name in SCHEMAS else df).write.mode("overwrite").parquet(f"{folder}/{name}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in tables}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """check, key, value: rows that break a constraint, of the tables that are there."""
    found = [tables[t].agg(F.count_if(F.expr(rule)).alias("value")).select(F.lit("constraint").alias("check"), F.lit(f"{t}.{rule}").alias("key"), "value") for t, rule in CONSTRAINTS if t in tables]
    return reduce(DataFrame.unionByName, found)


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """check, key, value: by how many rows each table misses the number expected."""
    found = [tables[t].agg(F.abs(F.count("*") - F.lit(n)).alias("value")).select(F.lit("row_count").alias("check"), F.lit(t).alias("key"), "value") for t, n in expected.items()]
    return reduce(DataFrame.unionByName, found)


def checks(tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """check, key, value, sample: row counts, null keys, orphans of every reference, constraints."""
    found = [null_keys({n: tables[n] for n in KEYS if n in tables}, KEYS), violations(tables)]
    found += [row_counts(tables, expected)] if expected else []
    found = [f.withColumn("sample", F.lit(None).cast("string")) for f in found]
    for child, column, parent in REFERENCES:
        if child in tables and parent in tables and column in tables[child].columns:
            found.append(orphans(tables[child], column, tables[parent], KEYS[parent]).select(F.lit("orphan").alias("check"), F.lit(f"{child}.{column}").alias("key"), "value", F.array_join("sample", ",").alias("sample")))
    return reduce(DataFrame.unionByName, found)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_index(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)
