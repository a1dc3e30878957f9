"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text: one of the words that
stand out in toxic documents, one of the words of ordinary documents.  A window
(a word, and its beginnings of ``STARTS`` bytes) is compressed with both; the
difference of the two lengths says which text it resembles, and whether the toxic
dictionary holds it from end to end is told by the shorter length.  A logistic curve over a document's distribution of
differences, fitted on documents that the dictionaries have not seen, turns it
into a score between 0 and 1.

The classifier is fitted on a bounded sample of labelled rows: at most ``max_toxic``
toxic and ``max_ordinary`` ordinary ones, those of smallest hash, and of each kind no
more than ``max_bytes`` of text; scoring covers every document and its whole text, and
reads nothing but the text.  How telling a word must be, and whether beginnings of
words count, is chosen by cross-validation inside that sample, the trials in tasks of
their own.

Nulls: a null text counts as empty, a null doc_id is scored and never held out;
labels that are null are not learnt from.  Empty texts get the score of a
document without windows.  Texts of any length are scored whole.  Repeated rows are
each scored; a doc_id labelled more than once is toxic if one label says so; of equal
losses the first trial wins.  Without labels of both kinds the score is the share of
toxic labels (0 if there are none).  An empty table gives no rows.  A column of the
input that bears the name of the score leaves as input_<name>.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as V
from .common import apart, small_batches, table

#: ASCII letters in lower case, digits and all bytes of other letters stay; the rest separates words.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)], dtype=np.uint8)
#: A string that ends both dictionaries and every window, so that even a short window becomes a compressed block.
CARRIER = bytes(range(1, 25))
LEVELS = 26  # differences are clipped to -13 .. 12
WHOLE = 13  # levels 0 .. 12 of windows that the toxic dictionary holds as they are
CUTS = (2, 3, 4, 5, 6)
#: Lengths in bytes of the beginnings of words that count as windows, marked by a byte that no word holds;
#: insults with changing endings are known by them.
STARTS = (4, 5, 6, 7)
MARK = b"_"


def starts_of(word: bytes, lengths: tuple = STARTS) -> list[bytes]:
    return [word[:n] + MARK for n in lengths if len(word) >= n]


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list = field(default_factory=list)
    mean: list = field(default_factory=list)
    scale: list = field(default_factory=list)
    prior: float = 0.0
    starts: tuple = STARTS


class Distances:
    """Compression differences of words, each distinct word compressed once per task."""

    def __init__(self, toxic: bytes, ordinary: bytes, starts: tuple = STARTS, most: int = 200_000):
        import zstandard as Z

        def compressor(raw: bytes):
            params = Z.ZstdCompressionParameters.from_level(3, min_match=3, strategy=Z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
            return Z.ZstdCompressor(dict_data=Z.ZstdCompressionDict(raw, dict_type=Z.DICT_TYPE_RAWCONTENT), compression_params=params)

        self.a, self.b, self.most = compressor(toxic), compressor(ordinary), most
        # what a window costs that is one match, with the carrier as another: that of the last word but one
        known = toxic[: -len(CARRIER)]
        telling = known and not known.endswith(b"  ")  # without telling words nothing is a match of one
        self.least = len(self.a.compress(b" " + b"".join(known.split()[-2:-1]) + b" " + CARRIER)) if telling else 0
        self.hasher, self.starts = V.Hasher(), starts
        self.begun: dict[bytes, int] = {}
        self.keys, self.values = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8)

    def of(self, word: bytes) -> int:
        """The level of a word: its clipped difference, in a range of its own if it is a match from end to
        end, so that a telling word is not taken for a longer one that merely shares letters with it."""
        level = max((self._start(s) for s in starts_of(word, self.starts)), default=0)
        x = b" " + word + b" " + CARRIER
        a = len(self.a.compress(x))
        d = max(-13, min(12, len(self.b.compress(x)) - a))
        return max(level, LEVELS + d if d > 0 and a <= self.least else 13 + d)

    def _start(self, start: bytes) -> int:
        """The level of a word's beginning if it is a match from end to end, else 0."""
        level = self.begun.get(start)
        if level is None:
            x = b" " + start + b" " + CARRIER
            a = len(self.a.compress(x))
            d = min(12, len(self.b.compress(x)) - a) if a <= self.least else 0
            if len(self.begun) >= self.most:
                self.begun.clear()
            level = self.begun[start] = LEVELS + d if d > 0 else 0
        return level

    def histogram(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each document the number of windows at each level."""
        data = FOLD[data]
        starts, ends, first = V.word_bounds(data, offsets)
        hashes = self.hasher.words(data, starts, ends)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), dtype=bool)
        values = np.zeros(len(unique), dtype=np.int8)
        values[known] = self.values[at[known]]
        raw = data.tobytes()
        new = np.flatnonzero(~known)
        values[new] = [self.of(raw[starts[i] : ends[i]]) for i in index[new]]
        if len(self.keys) + len(new) > self.most:
            self.keys, self.values = unique, values
        elif len(new):
            keys, vals = np.concatenate([self.keys, unique[new]]), np.concatenate([self.values, values[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], vals[order]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        n = len(first) - 1
        return np.bincount(doc * (LEVELS + WHOLE) + values[inverse], minlength=n * (LEVELS + WHOLE)).reshape(n, LEVELS + WHOLE)


def features(hist: np.ndarray) -> np.ndarray:
    n = hist.sum(axis=1)
    whole = np.cumsum(hist[:, :LEVELS - 1:-1], axis=1)[:, ::-1]  # whole matches at a difference of at least 0 .. 12
    hist = hist[:, :LEVELS] + np.pad(hist[:, LEVELS:], ((0, 0), (LEVELS - WHOLE, 0)))
    above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]  # windows at a difference of at least the column's
    levels = np.arange(LEVELS) - 13.0
    tops = []
    for k in (1, 2, 3):
        tops.append(np.where(n >= k, levels[np.maximum((above >= k).sum(axis=1) - 1, 0)], 0.0))
    counts = [above[:, 13 + k] for k in CUTS]
    size = np.maximum(n, 1)
    counts += [whole[:, k] for k in (1, 2, 3)]
    return np.column_stack([tops[0], (tops[0] + tops[1] + tops[2]) / 3, *[np.log1p(c) for c in counts], *[np.sqrt(c / size) for c in counts], np.log1p(n)])


def leaders(sets: list, share: float = 0.7) -> list[int]:
    """For each word set the first one, itself led by none, with which it shares at least ``share`` of the
    distinct words of both (Jaccard); its own number if there is none.  Sets, or arrays of distinct word numbers.

    Only leaders are compared with: sets that near have a word in common among the rarest
    1 - ``share`` of each."""
    numbers: dict = {}
    sets = [s if isinstance(s, np.ndarray) else np.array([numbers.setdefault(w, len(numbers)) for w in s], dtype=np.int64) for s in sets]
    df = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *sets]))
    index: dict[int, list[int]] = {}
    out, blank = [], None
    for i, s in enumerate(sets):
        if not len(s):
            blank = i if blank is None else blank
            out.append(blank)
            continue
        rare = s[np.lexsort((s, df[s]))][: len(s) - math.ceil(share * len(s)) + 1].tolist()
        near = i
        for j in sorted({j for w in rare for j in index.get(w, ())}):
            t = sets[j]
            if min(len(s), len(t)) >= share * max(len(s), len(t)):
                both = int(np.isin(s, t, assume_unique=True).sum())
                if both >= share * (len(s) + len(t) - both):
                    near = j
                    break
        if near == i:
            for w in rare:
                index.setdefault(w, []).append(i)
        out.append(near)
    return out


class Sample:
    """Labelled texts as word numbers: ``words``, ``tokens`` of all texts end to end, ``first`` token of each, toxic ``y``, ``half``."""

    def __init__(self, words, tokens, first, y, half):
        self.words, self.tokens, self.first, self.y, self.half = words, tokens, first, y, half

    @classmethod
    def of(cls, rows: Iterable[tuple[str, int]]) -> Sample:
        import zlib

        numbers: dict[bytes, int] = {}
        texts, toxic = [], []
        for text, kind in rows:
            texts.append(np.array([numbers.setdefault(w, len(numbers)) for w in FOLD[np.frombuffer((text or "").encode(), dtype=np.uint8)].tobytes().split()], dtype=np.int32))
            toxic.append(int(kind))
        words = list(numbers)
        # every row is learnt from; near copies stay in one half, so that neither half has seen the other's
        sets = [np.unique(t).astype(np.int64) for t in texts]
        half = [zlib.crc32(b" ".join(sorted(words[i] for i in sets[lead].tolist()))) & 1 for lead in leaders(sets)]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        return cls(words, np.concatenate([np.zeros(0, dtype=np.int32), *texts]), first, np.array(toxic), np.array(half))

    def held(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, word) of the distinct words of the chosen documents."""
        doc = np.repeat(np.arange(len(self.y)), np.diff(self.first))
        at = np.flatnonzero(chosen[doc])
        pairs = np.unique(doc[at] * len(self.words) + self.tokens[at])
        return pairs // max(1, len(self.words)), pairs % max(1, len(self.words))


def dictionaries(sample: Sample, chosen: np.ndarray, threshold: float, starts: tuple, size: int = 16_000) -> tuple[bytes, bytes]:
    """Two texts: the usual words followed by those that stand out in toxic documents by
    at least ``threshold`` standard deviations, and the usual words of ordinary documents."""
    doc, word = sample.held(chosen)
    toxic = sample.y[doc] == 1
    n = [int((sample.y[chosen] == k).sum()) for k in (0, 1)]
    df = [np.bincount(word[toxic == k], minlength=len(sample.words)) for k in (False, True)]
    counts = [(w, df[0][i], df[1][i]) for i, w in enumerate(sample.words) if df[1][i]]
    for length in starts:
        begun: dict[bytes, int] = {}
        of = np.array([begun.setdefault(w[:length] + MARK, len(begun)) if len(w) >= length else -1 for w in sample.words], dtype=np.int64)
        known = of[word] >= 0
        pairs = np.unique(doc[known] * (len(begun) + 1) + of[word[known]])
        both = [np.bincount(pairs[sample.y[pairs // (len(begun) + 1)] == k] % (len(begun) + 1), minlength=len(begun)) for k in (0, 1)]
        counts += [(s, both[0][i], both[1][i]) for s, i in begun.items() if both[1][i]]
    scores = []
    for w, other, k in counts:
        total = k + other
        z = (k - total * n[1] / (n[0] + n[1])) / math.sqrt(total * n[1] / (n[0] + n[1]) + 1)
        if k >= 3 and z >= threshold and 2 * k >= total:
            scores.append((z, w))
    telling = [w for _, w in sorted(scores)]
    drop = set(telling)
    texts = []
    for kind, last in ((1, telling), (0, [])):
        # what both kinds of text share compresses alike, whatever its language; the telling words stand nearest
        often = df[0] + df[1] if kind == 1 else df[0]
        usual = [w for _, w in sorted((int(often[i]), w) for i, w in enumerate(sample.words) if often[i] and w not in drop)]
        texts.append(b" " + b" ".join(usual)[-size:] + b" " + b" ".join(last)[-size:] + b" " + CARRIER)
    return tuple(texts)


def trial(sample: Sample, half: int, threshold: float, starts: tuple) -> np.ndarray:
    """Window counts by level of the documents of a half, by the dictionaries of the other one."""
    dist = Distances(*dictionaries(sample, sample.half != half, threshold, starts), starts)
    own = np.flatnonzero(sample.half == half)
    levels = np.zeros(len(sample.words), dtype=np.int64)
    tokens = [sample.tokens[sample.first[i] : sample.first[i + 1]] for i in own]
    for w in np.unique(np.concatenate([np.zeros(0, dtype=np.int32), *tokens])):
        levels[w] = dist.of(sample.words[w])
    return np.array([np.bincount(levels[t], minlength=LEVELS + WHOLE) for t in tokens], dtype=np.int64).reshape(len(own), LEVELS + WHOLE)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Standard deviations by which a telling word stands out, and lengths of beginnings of words, that are tried.
TRIALS = tuple((z, starts) for z in (3.0, 5.0, 12.0) for starts in (STARTS, ()))


def fit(rows: Sample | list[tuple[str, int]], trials: tuple = TRIALS, odds: float | None = None, spark=None) -> Model:
    """A model from (text, toxic) rows, for documents whose odds of being toxic are ``odds`` (default: those of
    the rows).  Each trial's dictionaries are built on one half and tried on the other; the trial of least
    logarithmic loss is kept and its curve refitted on the differences of unseen halves.  With ``spark`` the
    trials run as tasks."""
    sample = rows if isinstance(rows, Sample) else Sample.of(rows)
    y, halves = sample.y.astype(float), sample.half
    if len(y) == 0 or y.min() == y.max() or any(len(set(y[halves == h])) < 2 for h in (0, 1)):
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    jobs = [(h, z, starts) for z, starts in trials for h in (0, 1)]
    if spark is None:
        hists = [trial(sample, *job) for job in jobs]
    else:
        shared = spark.sparkContext.broadcast((sample.words, sample.tokens, sample.first, sample.y, sample.half))  # plain values: a broadcast is read without this package

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for i in batch.column("id").to_pylist():
                    hist = trial(Sample(*shared.value), *jobs[i])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([hist.astype(np.int32).tobytes()], pa.binary())], names=["id", "hist"])

        got = dict(map(tuple, spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(V.frugal(run), "id long, hist binary").collect()))
        hists = [np.frombuffer(got[i], dtype=np.int32).reshape(-1, LEVELS + WHOLE).astype(np.int64) for i in range(len(jobs))]
        shared.unpersist()
    best = None
    for t, (z, starts) in enumerate(trials):
        hist = np.zeros((len(y), LEVELS + WHOLE), dtype=np.int64)
        for h in (0, 1):
            hist[halves == h] = hists[2 * t + h]
        x = features(hist)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = (x - mean) / scale
        odd = np.arange(len(y)) % 2
        loss = 0.0
        for f in (0, 1):
            w = _logistic(x[odd != f], y[odd != f])
            p = np.clip(1 / (1 + np.exp(-np.clip(x[odd == f] @ w[:-1] + w[-1], -30, 30))), 1e-6, 1 - 1e-6)
            kind = y[odd == f]
            loss -= (kind * np.log(p) + (1 - kind) * np.log(1 - p)).sum()
        if best is None or loss < best[0]:
            best = (loss, z, starts, _logistic(x, y), mean, scale)
    _, z, starts, w, mean, scale = best
    if odds:
        w[-1] += math.log(odds) - math.log(y.mean() / (1 - y.mean()))
    toxic, ordinary = dictionaries(sample, np.ones(len(y), dtype=bool), z, starts)
    return Model(toxic, ordinary, w.tolist(), mean.tolist(), scale.tolist(), float(y.mean()), starts)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 2_000, max_ordinary: int = 4_000, max_bytes: int = 16_000_000) -> Model:
    """Fits on a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = dict(known.groupBy("toxic").count().collect())
    rank = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.where("toxic = 1").orderBy(*rank).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*rank).limit(max_ordinary))
    # rows of equal doc_id count as further rows, so both bounds hold for rows and for bytes; order by hash, as above
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    placed = rows.select("doc_id", F.xxhash64("text").alias("_text"), "toxic", "_bytes").withColumns(
        {"_row": F.row_number().over(W.partitionBy("toxic").orderBy(*rank, "_text")), "_end": F.sum("_bytes").over(W.partitionBy("toxic").orderBy(*rank, "_text").rowsBetween(W.unboundedPreceding, 0))}
    )
    most = F.when(F.col("toxic") == 1, max_toxic).otherwise(max_ordinary)
    taken = placed.where((F.col("_row") <= most) & (F.col("_end") <= max_bytes)).select("doc_id", "_text", "toxic", "_row")
    t, r = F.broadcast(taken.dropDuplicates(["doc_id", "_text"])).alias("t"), rows.alias("r")
    found = r.join(t, (F.col("r.doc_id") == F.col("t.doc_id")) & (F.xxhash64("r.text") == F.col("t._text"))).select("r.doc_id", "r.text", "r.toxic").collect()
    found.sort(key=lambda x: (str(x[0]), x[1] or ""))
    sample = Sample.of((x[1], x[2]) for x in found)
    del found  # the texts are not needed any more
    V.settle()
    model = fit(sample, odds=n.get(1, 0) / n[0] if n.get(0) else None, spark=docs.sparkSession)
    V.settle()
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and the score ``name`` (double, 0 to 1) from the column text."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if keep is None or c in keep]
    names = apart(docs.select(*columns), name)
    schema = T.StructType([T.StructField(names[c], docs.schema[c].dataType) for c in columns] + [T.StructField(name, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        dist = Distances(model.toxic, model.ordinary, tuple(model.starts)) if model.weights else None
        w, mean, scale = (np.array(x) for x in (model.weights, model.mean, model.scale))
        for batch in batches:
            out = np.full(batch.num_rows, model.prior)
            if dist is not None:
                for row, end, data, offsets in V.slices(batch.column("_scored"), 1 << 19):
                    x = (features(dist.histogram(data, offsets)) - mean) / scale
                    out[row:end] = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=schema.names)

    return docs.select(*[F.col(c).alias(names[c]) for c in columns], F.col("text").alias("_scored")).mapInArrow(V.frugal(run), schema)


def op3_toxicity(spark, sf_dir) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
