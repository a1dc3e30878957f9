"""A corpus from raw documents to token ids: toxicity, near duplicates, personal data, mixture, pieces.

Nulls, empty and long texts, ties, repeated rows and empty tables are as the stages' modules say.  All stages but
the last return the columns of their input, whatever further ones there are and whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import jaccard_join, mixing, pieces, pii, toxicity
from ledgerlake.llm.common import drop_written, scratch, table, written

#: Documents at this toxicity or above go.
TOXIC = 0.3


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below ``TOXIC`` stay; a column of theirs never clashes with the score, whose name no column has."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = "_" * (1 + max(len(c) for c in docs.columns))
    return toxicity.score(docs, model, name=name).where(F.col(name) < TOXIC).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id (rows without a doc_id all stay)."""
    joined = written(jaccard_join.join(docs), "joined")
    gone = joined.where("doc_id <> component_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= 1_000_000 else gone
    kept = docs.join(gone, "doc_id", "left_anti")
    again = joined.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mixing.emit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, round_trip of each document."""
    return pieces.encode(docs, pieces.load(), ["doc_id", "source"])


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("sentencepiece", encode)]

#: SQL can express neither the trained classifier nor the pieces; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote for itself, and what it read, is deleted after it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out: list[DataFrame] = []
        with scratch(spark, lambda out=out: out):
            out.append(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            drop_written(before)
        docs = before = out[0]
    return docs
