"""Chat formatting: logged snapshots of a growing conversation collapse to the longest.

Each turn has a hash of its position, role and text; their running sums along a
conversation are prefix hashes (four sums of 40 bits each).  A conversation whose
last prefix hash and length are a proper prefix point of another is dropped by an
anti-join; of equal conversations the smallest conv_id stays.  What is left is
rendered turn by turn.

Prefix points are grouped (combined before the shuffle) before the anti-join, so an
opening that all conversations share is one row.

Nulls: a null conv_id is a conversation of its own; null roles and texts count as
empty ones.  Turns are ordered by turn, role, text; rows equal in all three are further
turns, so ties need no rule.  Texts of any length are hashed whole; the turns of one
conversation are gathered in one row when it is rendered.  An empty table gives no rows.
Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SUMS = ("h0", "h1", "h2", "h3")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, at (position from 1), last (whether no turn follows), prefix hashes."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.row_number().over(order))
    digest = F.sha2(F.concat_ws("\u0001", F.col("at").cast("string"), *[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in ("role", "text")]).cast("binary"), 256)
    turns = turns.withColumn("_d", digest)
    limbs = {h: F.conv(F.substring("_d", 1 + 10 * i, 10), 16, 10).cast("long") for i, h in enumerate(SUMS)}
    parts = turns.select("conv_id", "at", *[v.alias(f"_{h}") for h, v in limbs.items()])
    run = W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return parts.select("conv_id", "at", (F.lead("at").over(W.partitionBy("conv_id").orderBy("at")).isNull()).alias("last"), *[F.sum(f"_{h}").over(run).alias(h) for h in SUMS])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other one continues."""
    marks = written(prefixes(turns), "prefixes")
    finals = marks.where("last").groupBy("at", *SUMS).agg(F.min(F.struct(F.col("conv_id").isNull().alias("_null"), F.col("conv_id").alias("conv_id"))).alias("_c"))
    points = marks.where("not last").select("at", *SUMS).distinct()
    return finals.join(points, ["at", *SUMS], "left_anti").select(F.col("_c.conv_id").alias("conv_id"), F.col("at").cast("long").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns, chat: each turn as <|role|>, its text and <|end|>, in order."""
    t, k = turns.select("conv_id", "turn", "role", "text").alias("t"), kept.alias("k")
    own = t.join(k, F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))).select("t.*", "n_turns")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    chat = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n<|end|>\n"))), "")
    return own.groupBy("conv_id", "n_turns").agg(lines.alias("_l")).select("conv_id", "n_turns", chat.alias("chat"))


def op9_chat_formatting(spark, sf_dir) -> DataFrame:
    """conv_id, n_turns, chat of every maximal conversation."""
    turns = table(spark, sf_dir, "conversations")
    return render(turns, maximal(turns))
