"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word of each of M full-dimensional codebooks, chosen by
beam search.  Codebooks start as residual k-means and are refitted by least squares
to the codes of the sample.  The index keeps each vector's codes, the squared norm
of its sum of words, and the vector.  A query's table of inner products with all
words gives the approximate distance to a row by M look-ups and the stored norm; the
best ``shortlist`` of each batch are ranked again by their exact distance.

The codebooks are fitted on the ``sample`` rows of smallest hash of vec_id; every
row is encoded.  Queries go in blocks of at most ``query_block`` (a bounded
broadcast), each against all rows.

Nulls: rows whose vec_id is null, whose vector is null, zero, of another length than
most, or holds a null or non-finite component take no part.  Ties go to the smaller
vec_id.  Rows are told apart by a number of their own: of rows with one vec_id each is
a query and each a candidate of the others.  An empty table gives no rows.  Other
columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written


@dataclass
class Codebooks:
    words: np.ndarray  # (M, K, d)


def encode(x: np.ndarray, books: Codebooks, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, M) of the best sums that a beam search finds, and the squared norms of the sums."""
    m, k, d = books.words.shape
    norms = (books.words**2).sum(axis=2)
    n = len(x)
    codes = np.zeros((n, 1, 0), dtype=np.int64)
    sums = np.zeros((n, 1, d))
    cost, norm = np.zeros((n, 1)), np.zeros((n, 1))  # |sum|^2 - 2 x.sum, and |sum|^2
    for j in range(m):
        words = books.words[j]
        width = codes.shape[1]
        add = norms[j] + 2 * (sums.reshape(n * width, d) @ words.T).reshape(n, width, k)
        wide = (cost[:, :, None] + add - 2 * (x @ words.T)[:, None]).reshape(n, -1)
        some = min(beam, wide.shape[1])
        best = np.argpartition(wide, some - 1, axis=1)[:, :some]
        row = np.arange(n)[:, None]
        parent, word = best // k, best % k
        cost = wide[row, best]
        norm = norm[row, parent] + add[row, parent, word]
        sums = sums[row, parent] + words[word]
        codes = np.concatenate([codes[row, parent], word[:, :, None]], axis=2)
    top = np.argmin(cost, axis=1)
    return codes[np.arange(n), top], norm[np.arange(n), top]


def fit(x: np.ndarray, m: int = 16, k: int = 256, rounds: int = 2, seed: int = 7) -> Codebooks:
    rng = np.random.RandomState(seed)
    residual, words = x.copy(), []
    k = max(1, min(k, len(x)))
    for _ in range(m):
        centres = residual[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(8):
            near = np.argmin((centres**2).sum(1) - 2 * residual @ centres.T, axis=1)
            for c in range(k):
                own = near == c
                if own.any():
                    centres[c] = residual[own].mean(axis=0)
        residual = residual - centres[np.argmin((centres**2).sum(1) - 2 * residual @ centres.T, axis=1)]
        words.append(centres)
    books = Codebooks(np.array(words))
    for _ in range(rounds):
        # least squares of one codebook at a time: its words become the means of what the others leave
        codes = np.concatenate([encode(part, books)[0] for part in np.array_split(x, max(1, len(x) // 500))])
        left = x - sum(books.words[j][codes[:, j]] for j in range(m))
        for j in range(m):
            left += books.words[j][codes[:, j]]
            total, count = np.zeros_like(books.words[j]), np.bincount(codes[:, j], minlength=k)
            np.add.at(total, codes[:, j], left)
            books.words[j][count > 0] = total[count > 0] / count[count > 0, None]
            left -= books.words[j][codes[:, j]]
    return books


def usable(vector: str) -> Column:
    """Whether a vector has only finite components, one of them not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def build(vectors: DataFrame, sample: int = 8192, m: int = 16, k: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, embedding, codes, norm for every usable row, and the codebooks."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return rows.select("vec_id", "embedding", F.lit(0).cast("long").alias("row"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("norm")), None
    dim = lengths[0][0]
    rows = rows.where(F.size("embedding") == dim).withColumn("row", F.monotonically_increasing_id())
    x = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(sample).collect()])
    books = fit(x, m, k)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("embedding")
            codes, norms = [], []
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for part in np.array_split(x, max(1, len(x) // 500)):
                if len(part):
                    c, n = encode(part, books)
                    codes += [r.tobytes() for r in c.astype(np.uint8)]
                    norms.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, batch.column("row"), pa.array(codes, pa.binary()), pa.array(np.concatenate(norms or [[]]))], names=["vec_id", "embedding", "row", "codes", "norm"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, row long, codes binary, norm double"), books


def search(index: DataFrame, books: Codebooks | None, queries: DataFrame, top: int = 10, shortlist: int = 600, query_block: int = 50_000) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest rows of ``index`` to each of ``queries``, rows of it.

    A task holds the vectors and the best of a block's queries; tables of inner products are made for a few
    queries at a time."""
    spark = index.sparkSession
    schema = "query_row long, query_id long, vec_id long, score double"
    blocks = -(-queries.count() // query_block) if books is not None else 0
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "embedding").collect()
        if not own:
            continue
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in own]), np.array([r[1] for r in own]), np.array([r[2] for r in own]), books.words))  # plain arrays: a broadcast is read without this package

        def run(batches, shared=shared):
            import pyarrow as pa

            rows, ids, q, words = shared.value
            m, k, dim = words.shape
            flat = words.reshape(m * k, dim)
            best_id = np.full((len(q), top), np.iinfo(np.int64).max)
            best = np.full((len(q), top), np.inf)
            for batch in batches:
                order = np.argsort(batch.column("vec_id").to_numpy(), kind="stable")
                vec, row = batch.column("vec_id").to_numpy()[order], batch.column("row").to_numpy()[order]
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order]
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, m)[order].astype(np.int64) + np.arange(m) * k
                norm = batch.column("norm").to_numpy()[order]
                for begin in range(0, len(q), 32):
                    part = np.arange(begin, min(begin + 32, len(q)))
                    tables = flat @ q[part].T  # inner products of all words with these queries
                    looked = np.zeros((len(vec), len(part)))
                    for j in range(m):
                        looked += tables[codes[:, j]]
                    close = (norm[:, None] - 2 * looked).T
                    close[row == rows[part][:, None]] = np.inf
                    for i, near in zip(part, close):
                        if len(vec) > shortlist:
                            edge = np.partition(near, shortlist - 1)[shortlist - 1]
                            inner = np.flatnonzero(near < edge)
                            pick = np.concatenate([inner, np.flatnonzero(near == edge)[: shortlist - len(inner)]])  # ties: smaller vec_id
                        else:
                            pick = np.arange(len(vec))
                        pick = pick[near[pick] < np.inf]
                        exact = np.sqrt(((x[pick] - q[i]) ** 2).sum(axis=1))
                        scores, names = np.concatenate([best[i], exact]), np.concatenate([best_id[i], vec[pick]])
                        keep = np.lexsort((names, scores))[:top]
                        best[i], best_id[i] = scores[keep], names[keep]
            some = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, top)[some.ravel()]), pa.array(np.repeat(ids, top)[some.ravel()]), pa.array(best_id[some]), pa.array(best[some])], names=["query_row", "query_id", "vec_id", "score"])

        found = found.unionByName(index.mapInArrow(run, schema))
    rank = F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark, sf_dir) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of all rows to every row whose vec_id is divisible by 100."""
    index, books = build(table(spark, sf_dir, "embeddings"))
    index = written(index, "index")
    return search(index, books, index.where("vec_id % 100 = 0"))
