"""Similarity join of documents on their sets of word n-grams.

Tiles are bands of set sizes: with a threshold of t per cent, band b holds the
sizes whose partners lie in bands b-1 and b only, so tile b (larger set in band
b) has each set at most twice.  Two sets of a tile that reach the threshold
differ in at most k elements.  The hash space is cut into somewhat more than k + 1
ranges, so that nearly every set has elements in more than k of them; of these at
least one holds the same elements in both sets.  The hash of the elements in a range
is therefore a lossless key: sets that share none cannot be linked.  (The few sets
with elements in k ranges or fewer give keys for their empty ranges too.)

A set with elements in f ranges shares at least f - k keys with any set it links
with; that number is its ``need``.  Keys of at most ``HOT`` sets give all their
pairs, and pairs are counted; keys of more sets give a star around their smallest
set.  A pair stays if its count and the hot keys of either set can reach the need of
both; a set stays in the stars if its hot keys alone reach its need.  So sets that
merely share a passage fall away, however many they are, and no link is lost.  What
is left is gathered in clusters; within it, bit counts of hashed bitmaps
bound the overlap from above and an intersection of the sorted arrays decides.

* Documents with equal sets are one class from the start (grouped by a digest,
  combined before the shuffle); only one of each class goes on.
* Keys travel packed, about 20 bytes for each 10 elements; arrays travel only for
  classes that share a key with another class.
* A large cluster is cut by bands of set sizes, and a band of many sets or elements
  into parts: only tiles of the same or of neighbouring bands are compared, each pair
  of tiles in a task of its own.
* Pairs that a cluster's links connect already are not compared again.
* Equal sets of more than a thousandth of all rows get their component by a broadcast
  (at most a thousand rows), so a group of copies is no hot key.

Hashes: words, n-grams and set digests have 64 bits; equality of two n-grams or
of two sets (digest and size) is taken from them.

Nulls: null and empty texts have an empty set, link with nothing and are their
own component; a null doc_id takes part like any other and its component has the
smallest non-null doc_id (null if there is none).  doc_id may be of any type that has
an order.  Repeated rows are returned as often as they occur; ties need no rule.  Texts
of any length are cut whole.  An empty table gives no rows.  Other columns of the input
are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as V
from .common import components, drop_written, small_batches, table, written

BITMAP_WORDS = 16  # 1,024 bits
HOT = 16
PACKED = 500_000  # keys held before they are packed
SLACK = 1.3  # filled ranges for each k + 1


def bands(limit: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest size of each band, the most elements that two linked sets of its tile
    differ in, and the number of ranges."""
    lows, differ, parts = [], [], []
    low = 1
    while low <= limit:
        high = max(low, low * 100 // percent)
        # 100 I >= p U and |x| + |y| = I + U give |x| + |y| - 2 I <= (|x| + |y|) (100 - p) / (100 + p)
        k = 2 * high * (100 - percent) // (100 + percent)
        least = -(-low * percent // 100)
        n = k + 1
        while k and n < 4 * (k + 1) and n * (1 - math.exp(-least / n)) < SLACK * (k + 1) + 3 * math.sqrt(n * math.exp(-least / n)):
            n += max(1, n // 64)
        lows.append(low)
        differ.append(k)
        parts.append(n)
        low = high + 1
    return np.array(lows or [1]), np.array(differ or [0]), np.array(parts or [1])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=out[1:])
    return out


class Sets:
    """The sorted distinct n-gram hashes of the documents of a slice, end to end."""

    def __init__(self, hasher: V.Hasher, data: np.ndarray, offsets: np.ndarray, n: int):
        starts, ends, first = V.word_bounds(data, offsets)
        hashes = hasher.words(V.LOWER[data], starts, ends)
        count = np.diff(first)
        grams = hasher.windows(hashes, n)
        doc = np.repeat(np.arange(len(count)), count)
        whole = np.arange(len(grams)) + n <= first[1:][doc[: len(grams)]]
        grams, owner = grams[whole], doc[: len(grams)][whole]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            grams = np.concatenate([grams, hasher.ranges(hashes, first[short], first[short + 1])])
            owner = np.concatenate([owner, short])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        self.grams, self.owner = grams[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(len(count) + 1))
        self.sizes = np.diff(self.first)

    def digests(self) -> np.ndarray:
        """A hash of each set; 0 for an empty one."""
        total = prefix_sums(V.mix(self.grams ^ np.uint64(0x5851F42D4C957F2D)))
        return np.where(self.sizes > 0, V.mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(np.uint64)), np.uint64(0))

    def keys(self, docs: np.ndarray, tile: np.ndarray, differ: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the hash ranges of the chosen documents in the given tiles, the index into docs of each, and the need of each document."""
        lengths = self.sizes[docs]
        which = np.repeat(np.arange(len(docs)), lengths)
        at = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.first[docs], lengths)
        grams = self.grams[at]
        part = ((grams >> np.uint64(32)) * parts[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        base = np.cumsum(parts) - parts
        total = prefix_sums(V.mix(grams ^ np.uint64(0x2545F4914F6CDD1D)))
        cut = np.searchsorted(base[which] + part, np.arange(parts.sum() + 1))
        sums = total[cut[1:]] - total[cut[:-1]]
        doc = np.repeat(np.arange(len(docs)), parts)
        index = (np.arange(parts.sum()) - base[doc]).astype(np.uint64)
        held = cut[1:] > cut[:-1]
        filled = np.bincount(doc[held], minlength=len(docs))
        need = np.maximum(filled - differ, 1)
        use = held | (filled <= differ)[doc]
        keys = V.mix(sums + V.mix((tile[doc].astype(np.uint64) << np.uint64(32)) + index + np.uint64(1)))
        return keys[use], doc[use], need


def bitmaps(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of BITMAP_WORDS 64-bit words for each set."""
    n = len(first) - 1
    bits = np.zeros((n, BITMAP_WORDS * 64), dtype=bool)
    bits[np.repeat(np.arange(n), np.diff(first)), (grams & np.uint64(BITMAP_WORDS * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def links(arrays: list[np.ndarray], percent: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that reach the threshold, enough to connect all that such pairs connect.
    With ``groups`` only pairs of different groups are compared."""
    n = len(arrays)
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    first = np.concatenate([[0], np.cumsum(sizes)])
    maps = bitmaps(np.concatenate(arrays), first)
    sorted_sizes, sorted_maps = sizes[order], maps[order]
    root = np.arange(n)  # of the position in order
    found = []
    for i in range(1, n):
        low = int(np.searchsorted(sorted_sizes, -(-sorted_sizes[i] * percent // 100)))
        while low < i:
            others = low + np.flatnonzero(root[low:i] != root[i])
            if groups is not None:
                others = others[groups[order[others]] != groups[order[i]]]
            if not len(others):
                break
            mine, theirs = sorted_maps[i], sorted_maps[others]
            bound = np.minimum(
                sorted_sizes[i] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64),
                sorted_sizes[others] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64),
            )
            enough = 100 * bound >= percent * (sorted_sizes[i] + sorted_sizes[others] - bound)
            joined = False
            a = arrays[order[i]]
            for j in others[enough][np.argsort(-bound[enough], kind="stable")]:
                if root[j] == root[i]:
                    continue
                b = arrays[order[j]]
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                if 100 * common >= percent * (len(a) + len(b) - common):
                    found.append((int(order[i]), int(order[j])))
                    root[root == root[j]] = root[i]
                    joined = True
                    break  # the rest is looked at again, without what is connected now
                # not linked: it stays out
                enough[np.searchsorted(others, j)] = False
            if not joined:
                break
    return found


def _base(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row, n_shingles, key (digest of the set, null if it is empty)."""

    def run(batches):
        import pyarrow as pa

        hasher = V.Hasher()
        for batch in batches:
            sizes, digests = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
            for _, _, data, offsets in V.slices(batch.column("text")):
                s = Sets(hasher, data, offsets, n)
                sizes.append(s.sizes)
                digests.append(s.digests())
            size, digest = np.concatenate(sizes), np.concatenate(digests).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(size.astype(np.int64)), pa.array(digest, mask=size == 0)], names=["doc_id", "row", "n_shingles", "key"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("key", T.LongType())])
    return docs.select("doc_id", "row", "text").mapInArrow(V.frugal(run), schema)


def _packed_keys(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """bucket, and packed (range key, set digest, need) triples."""

    def run(batches):
        import pyarrow as pa

        hasher = V.Hasher()
        for batch in batches:
            found, waiting = [], 0
            for _, end, data, offsets in V.slices(batch.column("text")):
                s = Sets(hasher, data, offsets, n)
                docs_ = np.flatnonzero(s.sizes > 0)
                size, digest = s.sizes[docs_], s.digests()[docs_]
                lows, differ, parts = bands(int(size.max(initial=1)) * 100 // percent + 2, percent)
                own = np.searchsorted(lows, size, side="right") - 1
                for band in (own, own + 1):
                    at_band = np.minimum(band, len(lows) - 1)
                    # a tile without differences links equal sets only, which are one class already
                    use = (band < len(lows)) & (differ[at_band] > 0) & ((band == own) | (100 * size >= percent * lows[at_band]))
                    if use.any():
                        keys, at, need = s.keys(docs_[use], band[use], differ[at_band[use]], parts[at_band[use]])
                        found.append((keys, digest[use][at], np.minimum(need, 65535).astype(np.uint16)[at]))  # a smaller need loses nothing
                        waiting += len(keys)
                if found and (waiting >= PACKED or end == batch.num_rows):
                    yield packed(*(np.concatenate(x) for x in zip(*found)), pa)
                    found, waiting = [], 0

    def packed(key, owner, need, pa):
        bucket = (key >> np.uint64(32)).astype(np.int64) * buckets >> 32
        order = np.argsort(bucket, kind="stable")
        present, at = np.unique(bucket[order], return_index=True)
        ends = [*at[1:], len(bucket)]
        return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *(pa.array([x[order[a:b]].tobytes() for a, b in zip(at, ends)], type=pa.binary()) for x in (key, owner, need))], names=["bucket", "keys", "owners", "needs"])

    return docs.select("text").mapInArrow(V.frugal(run), "bucket int, keys binary, owners binary, needs binary")


PAIR, STAR, HELD, NEED = range(4)


def shared(key: np.ndarray, owner: np.ndarray, need: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, a, b, n): how many keys each pair of sets shares, stars of hot keys, hot keys of each set, needs."""
    order = np.lexsort((owner, key))
    key, owner, need = key[order], owner[order], need[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner, need = key[fresh], owner[fresh], need[fresh].astype(np.int64)
    _, first, size = np.unique(key, return_index=True, return_counts=True)
    of = np.repeat(size, size)
    several = of > 1
    lefts, rights = [], []
    for d in range(1, HOT):
        i = np.flatnonzero((key[d:] == key[:-d]) & (of[d:] <= HOT)) if len(key) > d else np.zeros(0, dtype=np.int64)
        if not len(i):
            break
        lefts.append(owner[i])
        rights.append(owner[i + d])
    out = []

    def counted(kind: int, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            out.append((kind, a[at], b[at], np.diff(np.append(at, len(a)))))

    if lefts:
        counted(PAIR, np.concatenate(lefts), np.concatenate(rights))
    hot = of > HOT
    counted(HELD, owner[hot], np.zeros(hot.sum(), dtype=np.uint64))
    centre = np.repeat(owner[first], size)
    arm = hot & (centre != owner)
    counted(STAR, centre[arm], owner[arm])
    order = np.lexsort((need[several], owner[several]))
    o, m = owner[several][order], need[several][order]
    at = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, dtype=np.int64)
    out.append((NEED, o[at], np.zeros(len(at), dtype=np.uint64), m[at]))
    return out


def _candidates(packed: DataFrame) -> DataFrame:
    """Edges (a, b) between digests of sets that may be linked."""

    def run(table):
        import pyarrow as pa

        key, owner, need = (np.concatenate([np.frombuffer(x.as_py(), dtype=t) for x in table.column(c)]) for c, t in (("keys", np.uint64), ("owners", np.uint64), ("needs", np.uint16)))
        parts = shared(key, owner, need)
        kind = np.concatenate([np.full(len(a), k, dtype=np.int32) for k, a, _, _ in parts])
        a, b, n = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        V.settle()
        return pa.table({"kind": kind, "a": a.view(np.int64), "b": b.view(np.int64), "n": n.astype(np.int64)})

    rows = packed.groupBy("bucket").applyInArrow(run, "kind int, a long, b long, n long")
    total = written(rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.min("n").alias("least")), "shared")
    sets = total.where(F.col("kind") == NEED).select("a", F.col("least").alias("need"))
    held = total.where(F.col("kind") == HELD).select("a", F.col("n").alias("hot"))
    sets = sets.join(held, "a", "left").select("a", "need", F.coalesce("hot", F.lit(0)).alias("hot"))
    left, right = (sets.select(F.col("a").alias(c), F.col("need").alias(f"need_{c}"), F.col("hot").alias(f"hot_{c}")) for c in "ab")
    pairs = total.where(F.col("kind") == PAIR).join(left, "a").join(right, "b")
    pairs = pairs.where(F.col("n") >= F.greatest("need_a", "need_b") - F.least("hot_a", "hot_b")).select("a", "b")
    stars = total.where(F.col("kind") == STAR).join(right, "b").where("hot_b >= need_b").select("a", "b")
    return pairs.unionByName(stars)


def _arrays(docs: DataFrame, n: int) -> DataFrame:
    """key, n_shingles and the sorted hashes of each document, once for each slice."""

    def run(batches):
        import pyarrow as pa

        hasher = V.Hasher()
        for batch in batches:
            for _, _, data, offsets in V.slices(batch.column("text")):
                s = Sets(hasher, data, offsets, n)
                yield pa.RecordBatch.from_arrays([pa.array(s.digests().view(np.int64)), pa.array([s.grams[a:b].tobytes() for a, b in zip(s.first[:-1], s.first[1:])], type=pa.binary())], names=["key", "grams"])

    return docs.select("text").mapInArrow(V.frugal(run), "key long, grams binary")


def join(docs: DataFrame, n: int = 5, percent: int = 80, tile_rows: int = 4096, tile_elements: int = 8_000_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of equal sets), component_id for each row of ``docs``.

    ``n`` words an n-gram; two documents link at a Jaccard similarity of ``percent`` / 100 or more.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    base = written(_base(docs, n), "base")
    # of each class the row of the smallest doc_id stands for it, of a class without one the smallest row hash
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = base.where("key is not null").groupBy("key", "n_shingles").agg(first.alias("first"), F.count("*").alias("copies"))
    classes = written(classes.select("key", "n_shingles", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("row"), "copies"), "classes")
    elements, total = base.agg(F.sum("n_shingles"), F.count("*")).first()
    buckets = int(max(8, (elements or 0) // 1_000_000))
    edges = written(_candidates(_packed_keys(docs, n, percent, buckets)), "candidates")
    near = written(components(edges).withColumnRenamed("root", "cluster"), "near")
    drop_written(edges)
    # one document of each class that shares a key; where these are few the text need not be shuffled
    one = written(classes.join(near.withColumnRenamed("node", "key"), "key").select("key", "cluster", "row", "n_shingles"), "one")
    few = one.count() <= broadcast_rows
    chosen = docs.select("row", "text").join(F.broadcast(one.select("row").distinct()) if few else one.select("row").distinct(), "row", "left_semi")
    arrays = _arrays(chosen, n).groupBy("key").agg(F.first("grams").alias("grams"))
    lows, _, _ = bands(int(one.agg(F.max("n_shingles")).first()[0] or 1) + 1, percent)
    # small clusters are one tile; large ones are cut by size bands, and these into parts
    parts = lambda rows, grams: F.greatest(F.ceil(rows / tile_rows), F.ceil(grams / tile_elements))
    banded = one.withColumn("band", F.size(F.filter(F.lit(lows.tolist()), lambda low: low <= F.col("n_shingles"))))
    sizes = banded.groupBy("cluster", "band").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("grams"))
    whole = sizes.groupBy("cluster").agg((parts(F.sum("rows"), F.sum("grams")) > 1).alias("large"), F.map_from_entries(F.collect_list(F.struct("band", parts(F.col("rows"), F.col("grams")).cast("int").alias("parts")))).alias("parts"))
    rows = banded.join(whole, "cluster").join(arrays, "key")
    band = F.when(F.col("large"), F.col("band")).otherwise(0)
    own = F.when(F.col("large"), F.element_at("parts", F.col("band"))).otherwise(1)
    above = F.when(F.col("large"), F.coalesce(F.element_at("parts", F.col("band") + 1), F.lit(0))).otherwise(0)
    below = F.when(F.col("large"), F.coalesce(F.element_at("parts", F.col("band") - 1), F.lit(0))).otherwise(0)
    rows = rows.select("cluster", "key", "grams", band.alias("band"), own.alias("own"), above.alias("above"), below.alias("below")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("own")).cast("int"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda low, i, j: F.struct(low.alias("low"), i.alias("i"), j.alias("j"))
    same = F.transform(numbers(F.col("own")), lambda o: tile(2 * F.col("band"), F.least("part", o), F.greatest("part", o)))
    up = F.transform(numbers(F.col("above")), lambda o: tile(2 * F.col("band") + 1, F.col("part"), o))
    down = F.transform(numbers(F.col("below")), lambda o: tile(2 * F.col("band") - 1, o, F.col("part")))
    tiles = rows.select("cluster", "key", "grams", (F.col("band") * (1 << 20) + F.col("part")).alias("side"), F.explode(F.concat(same, up, down)).alias("t"))

    def verify(table):
        import pyarrow as pa

        keys = table.column("key").to_numpy()
        side = table.column("side").to_numpy()
        order = np.argsort(keys, kind="stable")
        arrays = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("grams")]
        found = links([arrays[i] for i in order], percent, None if len(set(side.tolist())) < 2 else side[order])
        V.settle()
        return pa.table({"a": pa.array([int(keys[order[i]]) for i, _ in found], pa.int64()), "b": pa.array([int(keys[order[j]]) for _, j in found], pa.int64())})

    linked = tiles.select("cluster", "key", "grams", "side", F.col("t.low").alias("low"), F.col("t.i").alias("i"), F.col("t.j").alias("j")).groupBy("cluster", "low", "i", "j")
    roots = components(linked.applyInArrow(verify, "a long, b long"))
    named = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = written(named.join(least, "root").select("key", "class_id", "component_id", "copies"), "named")
    for done in (near, one, classes):
        drop_written(done)
    # classes of very many copies are few: they are broadcast, and the others have no hot key
    hot = F.broadcast(named.where(F.col("copies") * 1000 > total).drop("copies"))
    names = ["doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")]
    rest = base.join(hot.select("key"), "key", "left_anti").join(named.drop("copies"), "key", "left")
    return base.join(hot, "key").select(*names).unionByName(rest.select(*names))


def op2_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    """doc_id, n_shingles, component_id (and class_id) at 3 words and a similarity of 0.9."""
    return join(table(spark, sf_dir, "documents"), n=3, percent=90)
