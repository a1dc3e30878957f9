"""Schemas of the warehouse tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DateType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

#: The columns of the nine tables, in order.
DDL = {
    "date_dim": "date_id int, full_date date, year int, quarter int, month int, month_name string, week_of_year int, day_of_month int, day_of_week int, day_name string, is_weekend int, is_month_start int, is_month_end int, fiscal_quarter string",
    "customers": "customer_id string, first_name string, last_name string, email string, phone string, city string, country string, zip_code string, signup_date date, is_active int, company string, loyalty_tier string, email_missing int, phone_missing int",
    "subscriptions": "subscription_id string, customer_id string, plan_name string, mrr double, currency string, start_date date, end_date date, status string, billing_cycle string, auto_renew int, mrr_was_negative int, is_future_start int",
    "transactions": "transaction_id string, customer_id string, subscription_id string, transaction_date date, amount double, currency string, status string, payment_method string, invoice_id string, description string, was_negative int",
    "invoices": "invoice_id string, customer_id string, subscription_id string, issue_date date, due_date date, subtotal double, tax double, total double, paid_amount double, payment_status string, paid_date date, payment_method string, currency string, tax_rate double, tax_error_flag int",
    "support_tickets": "ticket_id string, customer_id string, category string, priority string, status string, created_at timestamp, first_response_at timestamp, resolved_at timestamp, rating double, resolution_text string, agent_name string, channel string, is_escalated int",
    "product_usage": "usage_id string, customer_id string, feature_name string, session_date date, session_duration_seconds double, usage_count double, device string, session_id string, duration_invalid int, usage_count_outlier int, customer_id_missing int",
    "audit_log": "id string, timestamp timestamp, user_question string, tools_used array<string>, generated_sql string, classification string, result_summary string, execution_time_ms double, approval_status string, reviewer_notes string",
    "approval_queue": "id string, timestamp timestamp, user_question string, generated_sql string, classification string, reason string, status string, reviewer_notes string, reviewed_at timestamp, result_cache string",
}

TYPES = {"int": IntegerType(), "double": DoubleType(), "string": StringType(), "date": DateType(), "timestamp": TimestampType(), "array<string>": ArrayType(StringType())}

SCHEMAS = {name: StructType([StructField(column, TYPES[kind]) for column, kind in map(str.split, ddl.split(", "))]) for name, ddl in DDL.items()}
