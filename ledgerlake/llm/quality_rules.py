"""Quality rules: per-document counts, and lines that too many documents of a host share.

Lines are normalised (ASCII lower case, every digit 0, words joined by one space)
and hashed; the distinct documents that hold a line are counted for each host.  A
line is removed where more than ``share`` of the host's documents, and more than
``least_docs`` of them, hold it.  A document is kept unless the per-document rules
fail it or fewer than ``left`` of its words (or fewer than 10) remain.

``clean`` gives the kept documents without those lines.

Nulls: a null text is empty and fails (fewer than 10 words); a null host is a host
of its own; a null doc_id is carried along; doc_id and host may be of any type.  Texts
of any length are read whole.  Repeated rows are documents of their own, each counted;
a line that a document holds twice counts once, and goes each time.  Ties: a line held
by exactly the limit stays.  An empty table gives no rows.  ``rules`` looks at no other
column; ``clean`` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as V
from .common import own, small_batches, table, written

NORMAL = V.LOWER.copy()
NORMAL[48:58] = 48
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _twice(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (owner, hash) pairs occur more than once, and which are later ones."""
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    many, later = (np.zeros(len(order), dtype=bool) for _ in range(2))
    many[order] = same | np.append(same[1:], False)
    later[order] = same  # stable: the first in the text stays first
    return many, later


def measure(hasher: V.Hasher, data: np.ndarray, offsets: np.ndarray, n: int = 5) -> dict[str, np.ndarray]:
    """The counts of each document of a slice, and its distinct normalised lines with their words."""
    starts, ends, first = V.word_bounds(data, offsets)
    docs = len(offsets) - 1
    count = np.diff(first)
    doc = np.repeat(np.arange(docs), count)
    out = {"n_words": count, "word_chars": _per_doc(V.IS_WORD[data] & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_doc(IS_SYMBOL[data], offsets)}
    windows = hasher.windows(hasher.words(data, starts, ends), n)
    cover = np.zeros(len(doc) + 1, dtype=np.int64)
    if len(windows):
        at = np.flatnonzero(np.arange(len(windows)) + n <= first[1:][doc[: len(windows)]])
        many, _ = _twice(windows[at], doc[at])
        np.add.at(cover, at[many], 1)
        np.add.at(cover, at[many] + n, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(cover[:-1]) > 0, first)
    # lines with a word: from a document's start or a line break to the next break or its end
    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    begin = begin[begin < len(data)]
    if len(data):
        stop = np.append(begin[1:], len(data))
        stop = np.where((stop > begin) & (data[stop - 1] == 10), stop - 1, stop)
        word = np.searchsorted(starts, begin)
        words = np.searchsorted(starts, stop) - word
        real = words > 0
        begin, stop, word, words = begin[real], stop[real], word[real], words[real]
    else:
        begin = stop = word = words = np.zeros(0, dtype=np.int64)
    line_doc = np.searchsorted(offsets, begin, side="right") - 1
    _, later = _twice(hasher.words(data, begin, stop), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=docs)
    normal = hasher.ranges(hasher.words(NORMAL[data], starts, ends), word, word + words)
    order = np.lexsort((normal, line_doc))
    normal, line_doc, words = normal[order], line_doc[order], words[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (normal[1:] != normal[:-1]) | (line_doc[1:] != line_doc[:-1])
    at = np.flatnonzero(new)
    out["lines"] = normal[at]
    out["line_words"] = np.add.reduceat(words, at) if len(at) else words
    out["line_first"] = np.searchsorted(line_doc[at], np.arange(docs + 1))
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(docs: DataFrame, host: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        hasher = V.Hasher()
        for batch in batches:
            for row, end, data, offsets in V.slices(batch.column("text")):
                m = measure(hasher, data, offsets)
                first = pa.array(m["line_first"].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), batch.column("host").slice(row, end - row), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), pa.ListArray.from_arrays(first, pa.array(m["lines"].view(np.int64))), pa.ListArray.from_arrays(first, pa.array(m["line_words"].astype(np.int64)))],
                    names=["doc_id", "host", *COUNTS, "lines", "line_words"],
                )

    return docs.select("doc_id", F.col(host).alias("host"), "text").mapInArrow(V.frugal(run), T.StructType([docs.schema["doc_id"], T.StructField("host", docs.schema[host].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("lines", "line_words"))]))


def _lines(base: DataFrame) -> DataFrame:
    return base.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))


def _frequent(base: DataFrame, share: float, least_docs: int, many_docs: int) -> DataFrame:
    """key (a hash of host and line) of the lines above the limits."""
    frequent = _lines(base).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    hosts = base.groupBy("host").agg(F.count("*").alias("docs"))
    over = (F.col("n") > many_docs) | (F.col("n") > share * F.col("docs"))
    found = written(frequent.join(hosts, frequent.host.eqNullSafe(hosts.host)).where(over).select(F.xxhash64(frequent.host, "line").alias("key")), "frequent")
    return F.broadcast(found) if found.count() <= 1_000_000 else found


def _verdict(base: DataFrame, frequent: DataFrame, left: float) -> DataFrame:
    removed = _lines(base).withColumn("key", F.xxhash64("host", "line")).join(frequent, "key").groupBy("row").agg(F.sum("words").alias("removed"), F.collect_set("line").alias("gone"))
    out = base.drop("lines", "line_words").join(removed, "row", "left").withColumn("words_left", F.col("n_words") - F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("words_left") < 10) | (F.col("words_left") < left * F.col("n_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})


def rules(docs: DataFrame, host: str = "source", share: float = 0.1, least_docs: int = 5, many_docs: int = 20, left: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, words_left and kept for each row of ``docs``."""
    small_batches(docs.sparkSession)
    base = written(_measured(docs, host).withColumn("row", F.monotonically_increasing_id()), "quality")
    return _verdict(base, _frequent(base, share, least_docs, many_docs), left).select("doc_id", *COUNTS, "base_failed", "words_left", "kept")


def clean(docs: DataFrame, host: str = "source", share: float = 0.1, least_docs: int = 5, many_docs: int = 20, left: float = 0.5) -> DataFrame:
    """The kept rows of ``docs``, their texts without the lines above the limits."""
    small_batches(docs.sparkSession)
    numbered = written(docs.select(own(docs), F.monotonically_increasing_id().alias("row")), "numbered")
    base = written(_measured(numbered.select(F.col("row").alias("doc_id"), F.col("_own").getField(host).alias("host"), F.col("_own.text").alias("text")), "host").withColumnRenamed("doc_id", "row"), "quality")
    verdict = _verdict(base, _frequent(base, share, least_docs, many_docs), left).where("kept").select("row", "gone")
    joined = numbered.join(verdict, "row").select("_own", F.col("_own.text").alias("text"), "gone")

    def run(batches):
        import pyarrow as pa

        hasher = V.Hasher()
        for batch in batches:
            out = [_strip(hasher, t, set(g or ())) for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_own"), pa.array(out, pa.string())], names=["_own", "text"])

    stripped = joined.mapInArrow(V.frugal(run), T.StructType([joined.schema["_own"], T.StructField("text", T.StringType())]))
    return stripped.select(*[F.col("text") if c == "text" else F.col("_own").getField(c).alias(c) for c in docs.columns])


def _strip(hasher: V.Hasher, text: str, gone: set[int]) -> str:
    """The text without the lines whose normalised hash is among ``gone``."""
    if not gone:
        return text
    kept = []
    for line in text.split("\n"):
        data = np.frombuffer(line.encode(), dtype=np.uint8)
        starts, ends, _ = V.word_bounds(data, np.array([0, len(data)]))
        if len(starts):
            words = hasher.words(NORMAL[data], starts, ends)
            if int(hasher.ranges(words, np.array([0]), np.array([len(words)])).view(np.int64)[0]) in gone:
                continue
        kept.append(line)
    return "\n".join(kept)


def op6_quality_rules(spark, sf_dir) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept (and words_left)."""
    return rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
