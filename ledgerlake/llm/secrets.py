"""Secret scan: patterns of known kinds, and random strings told from identifiers by Markov models.

Two character models (transitions between 64 classes of characters) are trained
from labelled samples, one on random strings and one on ordinary identifiers.  A
token that no pattern covers is a secret of kind ``random`` if the log-likelihood
ratio of its transitions exceeds the model's threshold: the smallest that at most
``false_rate`` of the ordinary samples exceed which were held back from training.

Everything is column expressions; only counts of transitions (64 x 64 numbers of
each kind) and the threshold are brought to the driver.

Nulls: a null text is empty and has no spans; a null doc_id is carried along.  Empty
texts have no spans, an empty table gives no rows.  Very long texts are scanned whole,
in time in proportion to their length and spans.  Repeated rows are each scanned.
Overlapping spans of different kinds all stay, ordered by start, then kind; a token
touched by a span of a known kind is none of kind ``random``.  A column of the input
named ``spans`` or ``base_spans`` leaves as input_spans, input_base_spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, own, released, table
from .spans import fold, let, listed, quoted, spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Runs long enough to be a key; shorter ones are too often random by chance.
TOKEN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Parts of ordinary identifiers, file names and settings; samples are built from pairs and triples of them.
PARTS = (
    "account address array audit balance batch billing buffer cache calendar category channel charge client cluster column "
    "config connection context count currency customer database date default delete delivery device document driver duration "
    "encode entry error event export feature field filter forecast format function gateway group handler header health history "
    "identifier import index input insert interval invoice item journal label language ledger length limit list loader local "
    "manager matrix memory message method metric model module monitor month name network number object option order output "
    "package page parser partition payment pipeline plan policy position price priority process product profile query queue "
    "rating record region report request response result revenue schema score section segment server session shard shuffle "
    "source status storage stream string subscription summary support system table target template ticket timeout token "
    "transaction type update usage user validation value vector version warehouse window worker writer"
)


def samples(spark: SparkSession, n: int = 8000) -> DataFrame:
    """(text, random): labelled samples of both kinds.

    Random: parts of digests in base 64, in hexadecimal of either case and as letters of both cases, 20 to 43 characters.
    Ordinary: identifiers of two to five parts in six spellings, some numbered, dates and versions, paths, UUIDs.
    """
    parts = F.array(*[F.lit(p) for p in PARTS.split()])
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    pick = lambda salt: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(parts)) + 1).cast("int"))
    base = spark.range(n).withColumns({"sha": F.sha2(F.col("id").cast("string").cast("binary"), 256), "w": F.slice(F.array(*[pick(k) for k in range(1, 6)]), F.lit(1), draw(6, 4) + 2)})
    camel = F.array_join(F.transform("w", F.initcap), "")
    md = F.md5(F.col("id").cast("string").cast("binary"))
    uuid = F.concat_ws("-", F.substring(md, 1, 8), F.substring(md, 9, 4), F.substring(md, 13, 4), F.substring(md, 17, 4), F.substring(md, 21, 12))
    date = F.concat(F.array_join("w", "-"), F.lit("-"), F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), draw(7, 4000)), "yyyy-MM-dd"))
    version = F.concat(F.array_join("w", "-"), F.lit("-v"), draw(8, 30).cast("string"), F.lit("-"), draw(9, 100).cast("string"))
    spelt = F.element_at(
        F.array(F.array_join("w", "_"), F.array_join("w", "-"), F.upper(F.array_join("w", "_")), camel, F.concat(F.lower(F.substring(camel, 1, 1)), F.expr("substring(array_join(transform(w, x -> initcap(x)), ''), 2)")), F.array_join("w", "/"), date, version, F.array_join("w", ""), uuid), draw(10, 10) + 1
    )
    number = F.when((draw(10, 10) < 6) & (draw(11, 2) == 0), draw(12, 2100).cast("string")).otherwise("")
    coded = F.base64(F.unhex("sha"))
    random = F.element_at(F.array(coded, F.translate(coded, "+/", "-_"), F.regexp_replace(coded, "[^A-Za-z]", ""), F.regexp_replace(coded, "[^A-Za-z0-9]", ""), F.col("sha"), F.upper(F.col("sha"))), draw(13, 6) + 1)
    random = F.substring(random, F.lit(1), draw(14, 24) + 20)
    return base.select("id", F.concat(spelt, number).alias("text"), F.lit(False).alias("random")).unionByName(base.select("id", random.alias("text"), F.lit(True).alias("random"))).drop("id")


@dataclass
class Model:
    ratios: list[float]
    threshold: float


def char_class(code: Column) -> Column:
    """0..25 lower case, 26..51 upper case, 52..61 digits, 62 the separators _ and -, 63 the rest."""
    return (
        F.when(code.between(97, 122), code - 97).when(code.between(65, 90), code - 39).when(code.between(48, 57), code + 4).when(code.isin(95, 45), F.lit(62)).otherwise(F.lit(63))
    )


def transitions(text: Column) -> Column:
    """Array of class * 64 + next class."""
    classes = F.transform(F.split(text, ""), lambda c: char_class(F.ascii(c)))
    pairs = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * 64 + b)
    return F.when(F.length(text) > 1, F.get(F.transform(F.array(classes), pairs), F.lit(0))).otherwise(F.array().cast("array<int>"))


def train(labelled_samples: DataFrame, smoothing: float = 0.5, false_rate: float = 0.001) -> Model:
    """From (text, random) rows: for each transition log P(next | class, random) - log P(next | class, ordinary),
    4,096 numbers, and the threshold.  Every fourth row by hash of its text is held back for the threshold.

    Null texts or labels are not learnt from.  Without samples nothing is random."""
    known = labelled_samples.where("text is not null and random is not null").withColumn("_held", F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    pairs = known.where(~F.col("_held")).select("random", F.explode(transitions(F.col("text"))).alias("pair"))
    counts = {(r[0], r[1]): r[2] for r in pairs.groupBy("random", "pair").count().collect()}

    def logp(kind: bool, pair: int) -> float:
        row = sum(counts.get((kind, pair // 64 * 64 + j), 0) for j in range(64))
        return math.log((counts.get((kind, pair), 0) + smoothing) / (row + 64 * smoothing))

    ratios = [logp(True, p) - logp(False, p) for p in range(64 * 64)]
    held = known.where(F.col("_held") & ~F.col("random")).select(ratio(F.col("text"), F.lit(ratios)).alias("r"))
    top = held.agg(F.percentile("r", F.lit(1 - false_rate))).first()[0]
    return Model(ratios, max(0.0, top) if top is not None else float("inf"))


def ratio(text: Column, model: Column) -> Column:
    """Log-likelihood ratio of a token: positive, the more likely random."""
    return F.aggregate(transitions(text), F.lit(0.0), lambda acc, p: acc + F.element_at(model, p + 1))


LABELLED = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"


def untouched(tokens: str, others: str) -> str:
    """SQL for the spans ``tokens``, which do not overlap each other, that no span of ``others`` touches: a pass from
    the left against spans that start before, a pass from the right against those that start inside."""
    right = lambda reach, s: (f"if({s}.rank = 3, {reach}, greatest({reach}, {s}.end))", f"if({s}.rank < 3 or {reach} <= {s}.start, {s}, null)")
    left = lambda nearest, s: (f"if({s}.rank = 3, {nearest}, {s}.start)", f"if({s}.rank = 3 and {nearest} >= {s}.end, {s}, null)")
    both = let("every", f"array_sort(concat({tokens}, {others}))", fold("every", "-1L", right, LABELLED))
    return let("rest", f"reverse({both})", f"reverse({fold('rest', '9223372036854775807L', left, LABELLED)})")


def _kind(found: str, kind: str, rank: int) -> str:
    return f"transform({found}, s -> named_struct('start', s.start, 'rank', {rank}, 'kind', '{kind}', 'end', s.end, 'score', 1.0D))"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, rank, kind, end, score)."""
    names = apart(docs, "base_spans", "spans")
    found = docs.select(own(docs), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    found = found.selectExpr("_own", *[f"{spans('_text', p, hint)} as {n}" for n, p, hint in (("_assign", ASSIGN, None), ("_access", ACCESS, "AKIA"), ("_hex", HEX, None), ("_token", TOKEN, None))])
    assign = f"filter(_assign, s -> length(regexp_extract(s.found, {quoted(ASSIGN)}, 2)) >= 6)"
    scored = F.transform("_token", lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), F.lit("random").alias("kind"), s["end"].alias("end"), ratio(s["found"], F.lit(model.ratios)).alias("score")))
    found = found.select("_own", F.expr(f"array_sort(concat({_kind(assign, 'assign', 0)}, {_kind('_access', 'access', 1)}, {_kind('_hex', 'hex', 2)}))").alias("_base"), F.filter(scored, lambda s: s["score"] > model.threshold).alias("_random"))
    found = found.select("_own", "_base", F.expr(f"if(size(_random) > 0 and size(_base) > 0, {untouched('_random', '_base')}, _random)").alias("_free"))
    return found.select(*released(names), F.col("_base").alias("base_spans"), F.array_sort(F.concat("_base", "_free")).alias("spans"))


def op1_secret_scans(spark, sf_dir) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(samples(spark)))
    counts = [F.expr(f"cast(size(filter(base_spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
