"""Request classes, row limits, warnings, reflection, audit log, approval queue and the guarded SQL entry."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ledgerlake.functions.cleaning import mask_pii

#: What blocks a request and what sends it to review, in order of precedence.
RULES = (
    ("MUTATING_SQL", "sql", "blocked", r"\b(INSERT\s+INTO|UPDATE\s+\w+|DELETE\s+FROM|DROP\s+TABLE|DROP\s+DATABASE|ALTER\s+TABLE|TRUNCATE\s+TABLE|CREATE\s+TABLE|REPLACE\s+INTO|MERGE\s+INTO)\b"),
    ("MUTATING_QUESTION", "question", "blocked", r"\b(delete|remove|drop|truncate|update|modify|alter|insert|add a row|change the (data|record|value)|set .+ to)\b"),
    ("PII_FIELDS_SQL", "sql", "requires_review", r"\b(email|phone|address|zip_code|first_name|last_name)\b"),
    ("PII_QUESTION", "question", "requires_review", r"\b(email|phone number|home address|personal (address|info|data|detail)|contact (detail|info)|full name|customer name)\b"),
    ("BULK_EXPORT", "question", "requires_review", r"\b(export all|download all|dump (all|the)? (data|records|customers|transactions)|bulk export|all records|all customers|all transactions|full (data|database) export|SELECT \* FROM customers|SELECT \* FROM transactions)\b"),
    ("FINANCIAL_ANOMALY", "question", "requires_review", r"\b(anomal|irregularit|fraud|irregularities|suspicious (transaction|payment|activity)|financial (irregularity|discrepancy|manipulation)|unusual (payment|charge|transaction)|double.billed|over.charged)\b"),
)
#: Words of a question and what its SQL should then name.
CONCEPTS = {
    "revenue": ["amount", "mrr", "total", "transactions", "invoices"], "customer": ["customer", "customers"], "churn": ["status", "cancelled", "churn", "subscriptions"],
    "ticket": ["support_tickets", "ticket", "tickets"], "feature": ["feature_name", "product_usage", "feature"], "subscription": ["subscriptions", "subscription"],
    "invoice": ["invoices", "invoice"], "mrr": ["mrr", "subscriptions"], "sla": ["resolution", "response", "sla"],
}
STRICT = ("revenue", "churn", "ticket")
#: Columns that must not be negative.
MONEY = ("amount", "mrr", "total", "revenue", "paid_amount", "subtotal")
MAX_ROWS = 1000


def classify(question: Column, sql: Column | None = None) -> Column:
    """GV1: struct(classification, rule) of the first rule that fits."""
    texts = {"question": question, "sql": F.coalesce(sql, F.lit("")) if sql is not None else F.lit("")}
    out = None
    for rule, where, tier, pattern in RULES:
        hit = texts[where].rlike("(?i)" + pattern)
        value = F.struct(F.lit(tier).alias("classification"), F.lit(rule).alias("rule"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("safe").alias("classification"), F.lit("DEFAULT_SAFE").alias("rule")))


def _masked(c: Column, kind: T.DataType) -> Column:
    """A value of any type with the strings in it masked: of structs the fields, of arrays the items, of maps the values."""
    if isinstance(kind, T.StringType):
        return mask_pii(c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_masked(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _masked(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _masked(v, kind.valueType))
    return c


def mask_all(df: DataFrame) -> DataFrame:
    """GV2 on every string, nested ones too."""
    return df.select(*[_masked(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def limit_rows(df: DataFrame, most: int = MAX_ROWS) -> tuple[DataFrame, str | None]:
    """GV3: the first ``most`` rows, and a warning if there are more."""
    if df.limit(most + 1).count() <= most:
        return df, None
    return df.limit(most), f"result limited to {most} rows; {df.count() - most} omitted"


def confidence_warning(confidence: float) -> str | None:
    return "low confidence: check before use" if confidence < 0.5 else None


def apply_all(df: DataFrame, confidence: float | None = None, most: int = MAX_ROWS) -> tuple[DataFrame, list[str]]:
    """GV2 to GV4: the first rows, masked, and the warnings."""
    rows, omitted = limit_rows(df, most)
    doubt = confidence_warning(confidence) if confidence is not None else None
    return mask_all(rows), [w for w in (omitted, doubt) if w]


def routing(calls: DataFrame) -> DataFrame:
    """``calls`` with what is missing of ``expected_tools`` in ``tools_used``, whether nothing is, and whether any is there."""
    missing = F.array_sort(F.array_except("expected_tools", "tools_used"))
    return calls.withColumns({"missing": missing, "passed": F.size(missing) == 0, "any_expected": F.arrays_overlap("expected_tools", "tools_used")})


def reflect(question: str, sql: str, answer: str, rows: list[dict]) -> tuple[bool, list[str]]:
    """GV5: whether SQL, values and answer fit the question, and what does not."""
    found, passed = [], True
    for word, names in CONCEPTS.items():
        if sql and word in question.lower() and not any(n in sql.lower() for n in names):
            found.append(f"the question names {word}, the SQL does not")
            passed &= word not in STRICT
    if any(str(c).lower() in MONEY and isinstance(v, (int, float)) and v < 0 for r in rows[:10] for c, v in r.items()):
        found.append("negative money")
        passed = False
    if len(answer.strip()) < 30:
        found.append("the answer is short")
        passed = False
    return passed, found


AUDIT = "id string, timestamp timestamp, user_question string, tools_used array<string>, generated_sql string, classification string, result_summary string, execution_time_ms double, approval_status string, reviewer_notes string"
QUEUE = "id string, timestamp timestamp, user_question string, generated_sql string, classification string, reason string, status string, reviewer_notes string"


class Log:
    """An append-only Parquet table."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.rows([]).write.mode("append").parquet(path)

    def rows(self, values: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(values, self.schema)

    def append(self, values: dict) -> str:
        key = values.get("id") or uuid.uuid4().hex
        names = [f.name for f in T.StructType.fromDDL(self.schema)]
        row = self.rows([tuple({**{n: None for n in names}, **values, "id": key}.values())]).withColumn("timestamp", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self.path)
        return key

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


class Audit(Log):
    """GV7."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, AUDIT)

    def record(self, **values) -> str:
        values["result_summary"] = (values.get("result_summary") or "")[:300]
        return self.append({"approval_status": "not_required", **values})

    def history(self, limit: int = 20, offset: int = 0, tool: str | None = None, classification: str | None = None) -> tuple[int, DataFrame]:
        df = self.read()
        if tool:
            df = df.where(F.exists("tools_used", lambda t: t.contains(tool)))
        if classification:
            df = df.where(F.col("classification") == classification)
        return df.count(), df.orderBy(F.desc("timestamp"), "id").offset(offset).limit(min(limit, 1000))

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """Rows by class, and the five tools used most in the last 200 rows."""
        df = self.read()
        last = df.orderBy(F.desc("timestamp"), "id").limit(200)
        return df.groupBy("classification").count(), last.select(F.explode("tools_used").alias("tool")).groupBy("tool").count().orderBy(F.desc("count"), "tool").limit(5)


class Queue(Log):
    """GV8: each change is an event; the state of an entry is its latest."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, QUEUE)

    def enqueue(self, question: str, sql: str | None, classification: str, reason: str) -> str:
        return self.append({"user_question": question, "generated_sql": sql, "classification": classification, "reason": reason, "status": "pending"})

    def state(self) -> DataFrame:
        last = W.partitionBy("id").orderBy(F.desc("timestamp"))
        return self.read().withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")

    def pending(self) -> DataFrame:
        return self.state().where("status = 'pending'").orderBy(F.desc("timestamp"))

    def list_all(self, limit: int = 100) -> DataFrame:
        return self.state().orderBy(F.desc("timestamp")).limit(limit)

    def get(self, key: str):
        return self.state().where(F.col("id") == key).first()

    def decide(self, key: str, approved: bool, reviewer: str = "reviewer", notes: str = "") -> None:
        row = self.get(key)
        if row is None:
            raise ValueError(f"entry {key} not found")
        if row["status"] != "pending":
            raise ValueError(f"entry {key} is already {row['status']}")
        self.append({**row.asDict(), "status": "approved" if approved else "rejected", "reviewer_notes": f"[{reviewer}] {notes}"})

    def stats(self) -> DataFrame:
        return self.state().groupBy("status").count()


def guarded_sql(spark: SparkSession, question: str, sql: str, audit: Audit, queue: Queue, max_rows: int = 50, repair: Callable[[str, str], str] | None = None) -> dict:
    """GV6: classified before it runs; blocked and reviewed requests do not run; results are limited
    (1 to 500 rows) and masked; all is logged.  SQL that cannot be analysed is tried once more as ``repair(sql, error)`` gives it."""
    max_rows = min(max(max_rows, 1), 500)
    c = spark.range(1).select(classify(F.lit(question), F.lit(sql)).alias("c")).first()["c"]
    verdict, data, entry = c["classification"], None, None
    if not sql.lstrip().lower().startswith(("select", "with")):
        verdict = "blocked"
    if verdict == "safe":
        try:
            found = spark.sql(sql)
        except AnalysisException as e:
            again = guarded_sql(spark, question, repair(sql, str(e)), audit, queue, max_rows) if repair else {"classification": verdict, "rule": c["rule"], "data": None, "queue_id": None, "error": str(e)}
            return again
        data = mask_all(found.limit(max_rows))
    elif verdict == "requires_review":
        entry = queue.enqueue(question, sql, verdict, c["rule"])
    audit.record(user_question=question, tools_used=["sql"], generated_sql=sql, classification=verdict, result_summary=json.dumps({"rule": c["rule"]}), approval_status="pending" if entry else "not_required")
    return {"classification": verdict, "rule": c["rule"], "data": data, "queue_id": entry}


def chart_data(spark: SparkSession, sql: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """x, y of at most 200 rows; the first column is x, the first other numeric one y."""
    df = spark.sql(sql).limit(200)
    x = x or df.columns[0]
    y = y or next((f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != x), df.columns[-1])
    return df.select(F.col(x).cast("string").alias("x"), F.coalesce(F.col(y).try_cast("double"), F.lit(0.0)).alias("y"))
