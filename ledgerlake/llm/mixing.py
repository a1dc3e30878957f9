"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's target is its weight's share of all words, at most ``repeats`` times
its size; what is over goes to the others by weight.  Blocks of equal size are
allocated to the sources by highest quotients target / (2 s + 1), and a source's
quota to its shards in the same way; what a shard cannot give goes to the source's
other shards.  A shard (documents of one source and hash
bucket, in order of a seeded hash) takes its quota as whole passes and a seeded
run of blocks; documents get the words of theirs that lie in it.

Shards are numbered for each source: a source has one for each ``shard_tokens`` of its
words, so that one with a third of all rows is spread over as many tasks as its words
need, and a small one is not scattered over shards of fewer words than a block.  The apportionment
looks only at the quotients around each party's share, which provably hold the
border between the last seat and the next.

Nulls: a null text has size 0; a null source is a source of its own, last in
order; a null doc_id is one more value.  Rows that are equal are told apart by
nothing, so which of them is taken does not matter.  Without words nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x20\x09-\x0D]++"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, group: list[str]) -> DataFrame:
    """``parties`` (group columns, votes double, seats long of the group) with ``won``: the seats of each.

    With d = votes of the group / seats, a party's true number of seats is within
    votes / d * parties / (2 seats) + 1 of round(votes / d).
    """
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    every = parties.withColumns({"_all": F.sum("votes").over(g), "_n": F.count("*").over(g), "_id": F.row_number().over(g.orderBy(F.desc("votes"), *[c for c in parties.columns if c not in ("votes", "seats")]))})
    share = F.when(F.col("_all") > 0, F.col("votes") / F.col("_all") * F.col("seats")).otherwise(0.0)
    every = every.withColumn("_share", share)
    margin = F.ceil(F.col("_share") * F.col("_n") / (2 * F.greatest(F.col("seats"), F.lit(1)))) + 1
    every = every.withColumns({"_low": F.greatest(F.lit(0).cast("long"), F.round("_share").cast("long") - margin), "_high": F.round("_share").cast("long") + margin})
    open_seats = F.col("seats") - F.sum("_low").over(g)
    every = every.withColumn("_open", open_seats)
    tried = every.where("votes > 0").select(*group, "_id", "_open", "votes", F.explode(F.sequence("_low", "_high")).alias("_s"))
    rank = F.row_number().over(g.orderBy(F.desc(F.col("votes") / (2 * F.col("_s") + 1)), "_s", "_id"))
    won = tried.withColumn("_rank", rank).where("_rank <= _open").groupBy(*group, "_id").agg(F.count("*").alias("_won"))
    left, right = every.alias("l"), won.alias("r")
    on = F.col("l._id") == F.col("r._id")
    for c in group:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, on, "left").select(*[F.col(f"l.{c}").alias(c) for c in parties.columns], (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("won"))


def targets(sizes: DataFrame, repeats: int = 3) -> DataFrame:
    """source, source_size, weight, target for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    # sources reach their cap in order of cap / weight; after the first k the others share what is left
    cap = repeats * F.col("source_size")
    order = W.partitionBy(F.lit(0)).orderBy(cap / F.col("weight"), F.asc_nulls_last("source"))
    every = W.partitionBy(F.lit(0))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"_caps": F.coalesce(F.sum(cap).over(before), F.lit(0)), "_weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)), "_total": F.sum("source_size").over(every)})
    per = per.withColumns({"_level": (F.col("_total") - F.col("_caps")) / F.col("_weights")})
    # the first whose cap the level does not exceed, and all after it, are below their caps
    free = F.col("_level") * F.col("weight") <= cap
    per = per.withColumn("_free", F.max(free.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) == 1)
    top = F.max(F.when(F.col("_free"), F.struct("_weights", "_caps"))).over(every)
    per = per.withColumn("_top", top)
    shared = (F.col("_total") - F.col("_top._caps")) * F.col("weight") / F.col("_top._weights")
    return per.select("source", "source_size", "weight", F.when(F.col("_free"), shared).otherwise(cap).cast("double").alias("target"))


def plan(sizes: DataFrame, repeats: int = 3, seed: int = 17, shard_tokens: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """For each (source, shard) how many whole passes and which run of words are taken; the number of shards of each source."""
    counted = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long")
    aims = written(targets(sizes, repeats).withColumn("shards", counted), "targets")
    total, least = aims.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = int(max(1, min(4096, total // 100_000, (least or 0) // 200, shard_tokens // 200)))
    quotas = sainte_lague(aims.drop("shards").withColumns({"votes": F.col("target"), "seats": F.lit(round(total / block))}), []).select("source", "source_size", "target", F.col("won").alias("quota"))
    held = sharded(sizes, aims, seed).groupBy("source", "shard").agg(F.sum("size").alias("tokens"))
    s, q = held.alias("s"), quotas.alias("q")
    parties = s.join(q, F.col("s.source").eqNullSafe(F.col("q.source"))).select("s.source", "shard", "tokens", "source_size", "target", F.col("tokens").cast("double").alias("votes"), F.col("quota").alias("seats"), F.col("quota").alias("quota"))
    won = sainte_lague(parties, ["source"])
    cap, g = repeats * F.col("tokens"), W.partitionBy("source")
    won = won.withColumn("_own", F.least(F.col("won") * block, cap))
    # what is over the caps of some shards goes to the others, in order of their numbers
    over = F.least(F.col("quota") * block, repeats * F.col("source_size")) - F.sum("_own").over(g)
    room = F.coalesce(F.sum(cap - F.col("_own")).over(g.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = won.withColumns({"_over": over, "_room": room}).withColumn("take", F.col("_own") + F.least(F.greatest(F.col("_over") - F.col("_room"), F.lit(0)), cap - F.col("_own")))
    won = won.withColumns({"passes": F.when(F.col("tokens") > 0, F.expr("take div tokens")).otherwise(F.lit(0).cast("long")), "rest": F.when(F.col("tokens") > 0, F.col("take") % F.col("tokens")).otherwise(F.lit(0).cast("long"))})
    places = F.expr(f"(tokens - rest) div {block} + 1")
    begin = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), places) * block
    return won.select("source", "shard", "source_size", "target", "passes", begin.alias("run_start"), (begin + F.col("rest")).alias("run_end")), aims.select("source", "shards")


def sharded(sizes: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """``sizes`` with ``shard``: the number of a row's shard among those of its source."""
    n = F.broadcast(counts.select(F.col("source").alias("_source"), F.col("shards").alias("_shards")))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("_shards")).cast("int")
    return sizes.join(n, sizes.source.eqNullSafe(F.col("_source"))).withColumn("shard", shard).drop("_source", "_shards")


def mix(docs: DataFrame, repeats: int = 3, seed: int = 17, shard_tokens: int = 1_000_000, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, passes, from_word, to_word (the run's part of the
    document), taken, and the further ``columns`` of ``docs`` for each row."""
    own = {c: f"_in_{c}" for c in columns}
    sizes = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *[F.col(c).alias(n) for c, n in own.items()])
    if not columns:
        sizes = written(sizes, "sizes")
        small = sizes
    else:
        small = written(sizes.select("doc_id", "source", "size"), "sizes")
    shares, counts = plan(small, repeats, seed, shard_tokens)
    shares = written(shares, "shares")
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size", *own.values()).rowsBetween(W.unboundedPreceding, 0)
    placed = sharded(sizes, counts, seed).withColumn("_end", F.sum("size").over(order))
    p, s = placed.alias("p"), shares.alias("s")
    both = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.shard") == F.col("s.shard")), "left")
    start = F.col("_end") - F.col("size")
    low = F.least(F.greatest(F.col("run_start") - start, F.lit(0)), F.col("size"))
    high = F.greatest(F.least(F.col("run_end") - start, F.col("size")), low)
    out = both.select("doc_id", F.col("p.source").alias("source"), "size", "source_size", "target", "passes", low.alias("from_word"), high.alias("to_word"), *own.values())
    return out.withColumn("taken", F.col("passes") * F.col("size") + F.col("to_word") - F.col("from_word")).select("doc_id", "source", "size", "source_size", "target", "passes", "from_word", "to_word", "taken", *[F.col(n).alias(c) for c, n in own.items() if c not in ("doc_id", "source")])


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each whole pass, and one for a part."""
    m = mix(docs.select("doc_id", "source", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_own")), columns=("text", "_own"), **options)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(words, (F.col("from_word") + 1).cast("int"), (F.col("to_word") - F.col("from_word")).cast("int")), " ")
    run = F.col("to_word") - F.col("from_word")
    whole = F.col("passes") + F.when((F.col("size") > 0) & (run == F.col("size")), 1).otherwise(0)
    cut = F.when((run > 0) & (run < F.col("size")), F.array(part)).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat("text", whole.cast("int")), cut)
    return m.where("taken > 0").select("_own", F.explode(texts).alias("_text")).select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_own.{c}") for c in docs.columns])


def op5_mixing(spark, sf_dir) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
