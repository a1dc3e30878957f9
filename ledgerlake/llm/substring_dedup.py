"""Removal of word windows that occur more than once in the corpus.

1. Every window of ``k`` words names the smallest hash of its inner grams (``k`` -
   ``spread`` + 1 words each), so equal windows name equal grams.  The named grams are
   counted, 4 bytes each, in blocks of their hashes (together ``block bits`` + 32 bits).
2. The grams named more than once go into a Bloom filter, which is broadcast.  Windows
   whose gram it does not know are unique.  All others, the candidates, are grouped by
   95 bits of hash over their words, to find those that occur once all the same.
3. Each group writes a cascade of Bloom filters that tells its unique windows from its
   repeated ones: the first holds the unique ones, the next the repeated ones that the
   first lets through, and so on until none is left, so no candidate is judged wrongly.
   The cascades, about 9 bits a unique window, are broadcast, and documents are read once
   more; words under a candidate that is not unique are removed.  Neither texts nor the
   places of windows travel.
4. With more unique windows among the candidates than ``broadcast_windows`` they are not
   broadcast: the candidates are grouped with their places, by 128 bits, and the documents
   joined with the places of the unique ones, which moves the texts once.

The filter of grams has at most 2 x ``max_cells`` bits, sized from the bytes of text; only
repeated grams fill it.  A fuller filter sends more windows to the exact grouping and never
changes the result.  Equal windows are sent to the grouping once for some hundred thousand
candidates, so a passage in a third of all documents is no hot key.

Nulls: a null text has no words; its kept text is empty.  A null doc_id is carried
along.  Repeated rows are repetitions like any other.  Texts shorter than a window
are kept whole; texts of any length are read whole.  doc_id may be of any type.  There
are no ties: every copy of a window goes.  An empty table gives no rows.  Other columns
of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as V
from .common import drop_written, small_batches, table, written

PACKED = 500_000  # windows or grams held before they are packed
CELLS = 4  # cells of a Bloom filter that a key sets
SALT = 0x632BE59BD9B4E019


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` consecutive values (len(x) - width + 1 of them)."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = op(out[: len(out) - step], out[step:])
        done += step
    return out


class Windows:
    """The windows of the documents of a slice: ``at`` first words, ``gram`` named hashes."""

    def __init__(self, hasher: V.Hasher, data: np.ndarray, offsets: np.ndarray, k: int, spread: int):
        starts, ends, self.first = V.word_bounds(data, offsets)
        self.k, self.hasher = k, hasher
        self.hashes = hasher.words(data, starts, ends)
        count = np.diff(self.first)
        doc = np.repeat(np.arange(len(count)), count)
        total = len(doc)
        if total < k:
            self.at, self.doc, self.gram, self.named = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64))
            return
        grams = hasher.windows(self.hashes, k - spread + 1)
        least = _slide(grams, spread, np.minimum)  # of the window at each position
        whole = np.arange(total - k + 1) + k <= self.first[1:][doc[: total - k + 1]]
        self.at = np.flatnonzero(whole)
        self.doc = doc[self.at]
        self.gram = least[self.at]
        # a gram is named if it is the least of one of the windows that hold it
        padded = np.zeros(len(grams) + spread - 1, dtype=np.uint64)
        padded[spread - 1 : spread - 1 + len(least)] = np.where(whole, least, np.uint64(0))
        self.named = grams[_slide(padded, spread, np.maximum) == grams]

    def exact(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.hasher.windows(self.hashes, self.k, base)[self.at[chosen]] for base in (V.WORD_BASE, V.WORD_BASE_2))

    def short(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 31 bits; the last bit of the second is left 0."""
        h1, h2 = self.exact(chosen)
        return h1, (h2 >> np.uint64(32)).astype(np.uint32) & ~np.uint32(1)


def _cells(x: np.ndarray, size) -> list[np.ndarray]:
    """The cells, below ``size``, of each hash."""
    low, high, mask = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1), np.uint64(0xFFFFFFFF)
    return [((low + np.uint64(i) * high & mask) * np.asarray(size, dtype=np.uint64) >> np.uint64(32)).astype(np.int64) for i in range(CELLS)]


def _bit(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(cells: list[np.ndarray], size: int) -> np.ndarray:
    bits = np.zeros(size, dtype=bool)
    for cell in cells:
        bits[cell] = True
    return np.packbits(bits, bitorder="little")


class Grams:
    """Which named grams are known as repeated: a Bloom filter in blocks, each over the 32 bits that follow those of the block."""

    def __init__(self, words: int, spread: int, max_cells: int):
        bits = min(max(16, int(words * 2 // (spread + 1)).bit_length()), max_cells.bit_length() - 1)
        self.block_bits = min(max(6, int(words >> 25).bit_length()), bits - 2)
        self.size = 1 << (bits + 1 - self.block_bits)  # cells of a block

    def keys(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = V.mix(grams + np.uint64(SALT))
        return (g >> np.uint64(64 - self.block_bits)).astype(np.int64), (g >> np.uint64(32 - self.block_bits)).astype(np.uint32)

    def cells(self, keys: np.ndarray) -> list[np.ndarray]:
        return _cells(V.mix(keys.astype(np.uint64) + np.uint64(SALT)), self.size)

    def bitmap(self, rows) -> np.ndarray:
        """The filter, from (block, bitmap of the block)."""
        out = np.zeros((self.size << self.block_bits) // 8, dtype=np.uint8)
        for block, part in rows:
            at = block * self.size // 8
            out[at : at + len(part)] = np.frombuffer(part, dtype=np.uint8)
        return out

    def repeated(self, grams: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        """False for grams named once; neighbouring windows mostly name the same gram, which is looked up once."""
        new = np.ones(len(grams), dtype=bool)
        new[1:] = grams[1:] != grams[:-1]
        block, keys = self.keys(grams[new])
        out = np.ones(len(keys), dtype=bool)
        for cell in self.cells(keys):
            out &= _bit(bitmap, block * self.size + cell)
        return out[np.cumsum(new) - 1]


def _named(docs: DataFrame, k: int, spread: int, grams: Grams) -> DataFrame:
    """block, and the named grams of it (twice, if they are named more than once)."""
    def run(batches):
        import pyarrow as pa

        hasher, held, count = V.Hasher(), [], 0

        def packed():
            block, keys = grams.keys(np.concatenate(held))
            order = np.lexsort((keys, block))
            block, keys = block[order], keys[order]
            third = np.zeros(len(keys), dtype=bool)
            third[2:] = (keys[2:] == keys[:-2]) & (block[2:] == block[:-2])
            block, keys = block[~third], keys[~third]
            present, at = np.unique(block, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array([keys[a:b].tobytes() for a, b in zip(at, [*at[1:], len(keys)])], type=pa.binary())], names=["block", "keys"])

        for batch in batches:
            for _, _, data, offsets in V.slices(batch.column("text")):
                held.append(Windows(hasher, data, offsets, k, spread).named)
                count += len(held[-1])
                if count >= PACKED:
                    yield packed()
                    held, count = [], 0
        if count:
            yield packed()

    return docs.select("text").mapInArrow(V.frugal(run), "block int, keys binary")


def _filter(grams: Grams, named: DataFrame) -> np.ndarray:
    """The filter of the grams that are named more than once."""

    def merge(key, part):
        import pyarrow as pa

        keys = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in part.column("keys")])
        keys.sort()
        bitmap = _bitmap(grams.cells(keys[1:][keys[1:] == keys[:-1]]), grams.size).tobytes()
        V.settle()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([bitmap], pa.binary())})

    merged = written(named.groupBy("block").applyInArrow(merge, "block int, bitmap binary"), "grams")
    out = grams.bitmap(merged.toLocalIterator())
    drop_written(merged)
    return out


def _bucket(h1: np.ndarray, buckets: int) -> np.ndarray:
    return ((h1 >> np.uint64(32)).astype(np.int64) * buckets) >> 32


def _key(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """The hash of a window (64 and 31 bits) in the filter of a level."""
    return V.mix(h1 ^ V.mix(h2.astype(np.uint64) + np.uint64(SALT ^ level)))


def cascade(unique: tuple[np.ndarray, np.ndarray], repeated: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Filters, 8 bits a key, each of the keys that the one before lets through wrongly; the first is of the unique ones."""
    levels, held, others = [], unique, repeated
    while len(held[0]):
        size = 8 * (len(held[0]) + 1)
        bitmap = _bitmap(_cells(_key(*held, len(levels)), size), size)
        through = np.ones(len(others[0]), dtype=bool)
        for cell in _cells(_key(*others, len(levels)), size):
            through &= _bit(bitmap, cell)
        levels.append(bitmap.tobytes())
        held, others = tuple(x[through] for x in others), held
    return levels


def gathered(rows, buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level the filters of all buckets, and where that of a bucket starts and how long it is, from (bucket, levels)."""
    parts, starts, sizes = [], [], []
    for bucket, levels in rows:
        for level, bitmap in enumerate(levels):
            if level == len(parts):
                parts.append(bytearray())
                starts.append(np.zeros(buckets, dtype=np.int64))
                sizes.append(np.zeros(buckets, dtype=np.int64))
            starts[level][bucket], sizes[level][bucket] = len(parts[level]), len(bitmap)
            parts[level] += bitmap
    return [(np.frombuffer(p, dtype=np.uint8), a, n) for p, a, n in zip(parts, starts, sizes)]


def occurs_once(h1: np.ndarray, h2: np.ndarray, levels, buckets: int) -> np.ndarray:
    """What the cascades say of candidates."""
    out, left, bucket = np.zeros(len(h1), dtype=bool), np.arange(len(h1)), _bucket(h1, buckets)
    for level, (bitmap, starts, sizes) in enumerate(levels):
        left = left[sizes[bucket[left]] > 0]
        at, cells = 8 * starts[bucket[left]], _cells(_key(h1[left], h2[left], level), 8 * sizes[bucket[left]])
        through = np.ones(len(left), dtype=bool)
        for cell in cells:
            through &= _bit(bitmap, at + cell)
        left = left[through]
        out[left] = level % 2 == 0
    return out


def _keys(docs: DataFrame, grams: Grams, known, k: int, spread: int, buckets: int) -> DataFrame:
    """bucket, and packed hashes of the candidates; the last bit of h2 tells that a window is known to be repeated."""

    def run(batches):
        import pyarrow as pa

        hasher, bitmap, held, count = V.Hasher(), known.value, [], 0

        def packed():
            h1, h2 = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((h2, h1))
            h1, h2 = h1[order], h2[order]
            new = np.ones(len(h1) + 1, dtype=bool)
            new[1:-1] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            h2 = h2 | ~new[1:]  # another follows
            h1, h2 = h1[new[:-1]], h2[new[:-1]]
            present, at = np.unique(_bucket(h1, buckets), return_index=True)
            ends = [*at[1:], len(h1)]
            return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(at, ends)], type=pa.binary()) for x in (h1, h2))], names=["bucket", "h1", "h2"])

        for batch in batches:
            for _, _, data, offsets in V.slices(batch.column("text")):
                w = Windows(hasher, data, offsets, k, spread)
                chosen = np.flatnonzero(grams.repeated(w.gram, bitmap))
                if len(chosen):
                    held.append(w.short(chosen))
                    count += len(chosen)
                if count >= PACKED:
                    yield packed()
                    held, count = [], 0
        if count:
            yield packed()

    return docs.select("text").mapInArrow(V.frugal(run), "bucket int, h1 binary, h2 binary")


def _cascades(keys: DataFrame) -> DataFrame:
    """bucket, number of its unique windows, levels of its cascade."""

    def run(key, part):
        import pyarrow as pa

        h1, h2 = (np.concatenate([np.frombuffer(x.as_py(), dtype=t) for x in part.column(c)]) for c, t in (("h1", np.uint64), ("h2", np.uint32)))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        known, h2 = (h2 & np.uint32(1)).astype(bool), h2 & ~np.uint32(1)
        edge = np.ones(len(h1) + 1, dtype=bool)
        edge[1:-1] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        alone = edge[1:] & edge[:-1] & ~known
        others = edge[:-1] & ~alone
        levels = cascade((h1[alone], h2[alone]), (h1[others], h2[others]))
        V.settle()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "windows": pa.array([int(alone.sum())], pa.int64()), "levels": pa.array([levels], pa.list_(pa.binary()))})

    return keys.groupBy("bucket").applyInArrow(run, "bucket int, windows long, levels array<binary>")


def _candidates(docs: DataFrame, grams: Grams, known, k: int, spread: int, buckets: int) -> DataFrame:
    """bucket, and packed hash pairs, row keys and positions of candidates."""

    def run(batches):
        import pyarrow as pa

        hasher, bitmap = V.Hasher(), known.value
        for batch in batches:
            found, held = [], 0
            ids = batch.column("row_key").to_numpy()
            for row, end, data, offsets in V.slices(batch.column("text")):
                w = Windows(hasher, data, offsets, k, spread)
                chosen = np.flatnonzero(grams.repeated(w.gram, bitmap))
                if len(chosen):
                    h1, h2 = w.exact(chosen)
                    found.append((h1, h2, ids[row + w.doc[chosen]], (w.at[chosen] - w.first[w.doc[chosen]]).astype(np.int32)))
                    held += len(chosen)
                if found and (held >= PACKED or end == batch.num_rows):
                    yield packed(*(np.concatenate(x) for x in zip(*found)), pa)
                    found, held = [], 0

    def packed(h1, h2, doc, pos, pa):
        order = np.lexsort((h2, h1))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        repeated, later = (np.zeros(len(order), dtype=bool) for _ in range(2))
        repeated[order] = same | np.append(same[1:], False)
        later[order] = same
        pos = np.where(repeated, np.int32(-1), pos)  # known to be repeated: only its hash is of use to others
        doc = np.where(repeated, 0, doc)
        keep = np.flatnonzero(~later)
        bucket = _bucket(h1[keep], buckets)
        keep = keep[np.argsort(bucket, kind="stable")]
        present, at = np.unique(np.sort(bucket), return_index=True)
        ends = [*at[1:], len(keep)]
        return pa.RecordBatch.from_arrays(
            [pa.array(present.astype(np.int32)), *(pa.array([x[keep[a:b]].tobytes() for a, b in zip(at, ends)], type=pa.binary()) for x in (h1, h2, doc, pos))],
            names=["bucket", "h1", "h2", "doc", "pos"],
        )

    return docs.select("row_key", "text").mapInArrow(V.frugal(run), "bucket int, h1 binary, h2 binary, doc binary, pos binary")


def _unique(candidates: DataFrame) -> DataFrame:
    """(row_key, pos) of the windows among the candidates that occur once."""

    def run(table):
        import pyarrow as pa

        h1, h2, doc, pos = (np.concatenate([np.frombuffer(x.as_py(), dtype=t) for x in table.column(c)]) for c, t in (("h1", np.uint64), ("h2", np.uint64), ("doc", np.int64), ("pos", np.int32)))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        edge = np.ones(len(h1) + 1, dtype=bool)
        edge[1:-1] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        alone = order[edge[1:] & edge[:-1]]
        alone = alone[pos[alone] >= 0]
        V.settle()
        return pa.table({"row_key": doc[alone], "pos": pos[alone]})

    return candidates.groupBy("bucket").applyInArrow(run, "row_key long, pos int")


def dedup(docs: DataFrame, k: int = 35, spread: int = 16, max_cells: int = 1 << 28, broadcast_windows: int = 1 << 26) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) for each row of ``docs``."""
    return _dedup(docs, k, spread, max_cells, broadcast_windows, text=True)


def _dedup(docs: DataFrame, k: int, spread: int, max_cells: int, broadcast_windows: int, text: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = size // 6 + 1
    grams = Grams(words, spread, max_cells)
    known = spark.sparkContext.broadcast(_filter(grams, _named(docs, k, spread, grams)))
    buckets = int(max(8, words // 4_000_000))
    judged = written(_cascades(_keys(docs, grams, known, k, spread, buckets)), "cascades")
    few = (judged.agg(F.sum("windows")).first()[0] or 0) <= broadcast_windows
    if few:
        cascades = spark.sparkContext.broadcast(gathered(judged.where("windows > 0").select("bucket", "levels").toLocalIterator(), buckets))
        joined = docs
    else:
        cascades, docs = None, docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
        unique = written(_unique(_candidates(docs, grams, known, k, spread, buckets)), "unique")
        lists = unique.groupBy("row_key").agg(F.collect_list("pos").alias("unique_at"))
        joined = docs.join(lists, "row_key", "left").select("doc_id", "text", "unique_at")
    drop_written(judged)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        hasher, bitmap = V.Hasher(), known.value
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            n_words, n_removed, kept = [], [], []
            for row, end, data, offsets in V.slices(texts):
                w = Windows(hasher, data, offsets, k, spread)
                repeated = grams.repeated(w.gram, bitmap)
                cover = np.zeros(len(w.hashes) + 1, dtype=np.int32)
                if cascades is not None:
                    chosen = np.flatnonzero(repeated)
                    if len(chosen):
                        repeated[chosen] = ~occurs_once(*w.short(chosen), cascades.value, buckets)
                else:
                    part = batch.column("unique_at").slice(row, end - row)
                    flat = pc.list_flatten(part).to_numpy(zero_copy_only=False)
                    lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                    is_unique = np.zeros(len(w.hashes) + 1, dtype=bool)
                    is_unique[np.repeat(w.first[:-1], lengths) + flat] = True
                    repeated &= ~is_unique[w.at]
                at = w.at[repeated]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + k, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed = np.zeros(len(gone) + 1, dtype=np.int64)
                np.cumsum(gone, out=removed[1:])
                n_words.append(np.diff(w.first))
                n_removed.append(removed[w.first[1:]] - removed[w.first[:-1]])
                raw = data.tobytes()
                for i in range(end - row):
                    a, b = w.first[i], w.first[i + 1]
                    if n_removed[-1][i] == b - a:
                        kept.append(b"")
                        continue
                    ws = raw[offsets[i] : offsets[i + 1]].split()
                    kept.append(b" ".join(ws if not n_removed[-1][i] else compress(ws, ~gone[a:b])))
            out = pa.array([x.decode() for x in kept], pa.string()) if text else pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n_words or [[]]).astype(np.int64)), pa.array(np.concatenate(n_removed or [[]]).astype(np.int64)), out], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(V.frugal(run), T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))


def op7_substring_dedup(spark, sf_dir) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 at windows of 35 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the digest is taken where the kept text is, so the text need not travel
    return _dedup(docs, 35, 16, 1 << 28, 1 << 26, text=False).withColumnRenamed("kept", "kept_sha256")
