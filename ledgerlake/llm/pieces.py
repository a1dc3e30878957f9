"""SentencePiece encoding and decoding by streaming Viterbi.

The pieces and scores of a model are used as they are: of all ways to cut a text
into pieces the one of highest total score is taken (of equal ones the one with
longer last pieces).  Characters without a piece become byte pieces, so decoding
gives back every text exactly.  With a BPE model this is the best-scored cut, which
need not be the one its merge order gives.

A path must pass every boundary that no piece spans; there all surviving
backpointers converge, and what lies before is committed.  Such boundaries are
found from the pairs of neighbouring bytes that occur inside pieces.  The stretches
between them are short and repeat, so each distinct one is cut once, all of a batch
together.  Stretches over ``LONG`` bytes go through ``Stream``, which keeps a window
of the longest piece and commits whenever its surviving paths meet.

Nulls: a null text has null ids, an empty one none; a null doc_id is carried along.
Texts of any length are encoded whole, a slice of about a megabyte at a time.  Repeated
rows are each encoded.  Of cuts of equal score the one with longer last pieces is taken.
A literal U+2581 is kept by its bytes.  An empty table gives no rows.  A column of the
input named ``ids``, ``n_tokens`` or ``round_trip`` leaves as input_<name>; ``decode``
replaces a column ``text``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .common import apart, small_batches, table

LONG = 64
SPACE = "▁"


@dataclass
class Vocabulary:
    """texts: bytes of every id (a space for the word mark); scores; usable: whether Viterbi may choose it."""

    texts: list[bytes]
    scores: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    n = sp.get_piece_size()
    texts, usable, byte_ids = [], np.zeros(n, dtype=bool), np.full(256, -1, dtype=np.int32)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(SPACE, " ").encode())
            usable[i] = True
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so not every text can be encoded")
    return Vocabulary(texts, np.array([sp.get_score(i) for i in range(n)]), usable, byte_ids)


class Stream:
    """Viterbi over bytes that arrive piece by piece; ``feed`` and ``close`` return committed ids."""

    def __init__(self, v: Vocabulary, every: int = 32):
        self.ids = {t: i for i, t in enumerate(v.texts) if v.usable[i]}
        self.scores, self.byte_ids, self.every = v.scores, v.byte_ids, every
        self.most = max(map(len, self.ids), default=1)
        self.unknown = float(v.scores[v.usable].min()) - 10 if v.usable.any() else -10.0
        self.reset()

    def reset(self) -> None:
        self.text, self.base = b"", 0  # bytes from position base on
        self.best: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}  # position: score, start, id
        self.committed = self.end = 0

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        self.text += data
        n = self.base + len(self.text)
        while self.end < n:
            at = self.end + 1
            self.end = at
            if at < n and self.text[at - self.base] & 0xC0 == 0x80:
                continue  # inside a character
            best, single = None, None
            for start in range(max(self.committed, at - self.most), at):
                before = self.best.get(start)
                if before is None:
                    continue
                piece = self.ids.get(self.text[start - self.base : at - self.base])
                if piece is not None:
                    score = before[0] + self.scores[piece]
                    if best is None or score > best[0]:
                        best = (score, start, piece)
                single = start
            if single is not None and self.text[single - self.base : at - self.base] not in self.ids:
                score = self.best[single][0] + self.unknown
                if best is None or score > best[0]:
                    best = (score, single, -1)
            if best is not None:
                self.best[at] = best
            if (at - self.committed) % self.every == 0:
                out += self._commit([p for p in range(max(self.committed, at - self.most), at + 1) if p in self.best])
        return out

    def _commit(self, survivors: list[int]) -> list[int]:
        """Emits the ids before the last boundary that the paths of all survivors share."""
        while len(set(survivors)) > 1:
            far = max(survivors)
            survivors = [self.best[p][1] if p == far else p for p in survivors]
        meet = survivors[0] if survivors else self.committed
        ids = self._path(meet)
        if meet > self.committed:
            self.best = {p: x for p, x in self.best.items() if p >= meet}
            self.text, self.base, self.committed = self.text[meet - self.base :], meet, meet
        return ids

    def _path(self, at: int) -> list[int]:
        out: list[list[int]] = []
        while at > self.committed:
            _, start, piece = self.best[at]
            out.append([piece] if piece >= 0 else [int(self.byte_ids[b]) for b in self.text[start - self.base : at - self.base]])
            at = start
        return [i for ids in reversed(out) for i in ids]

    def close(self) -> list[int]:
        out = self._path(self.end)
        self.reset()
        return out


class Encoder:
    """Cuts slices of documents; remembers distinct stretches."""

    def __init__(self, v: Vocabulary, most: int = 200_000):
        self.v, self.most, self.hasher, self.stream = v, most, V.Hasher(), Stream(v)
        usable = np.flatnonzero(v.usable)
        raw = np.frombuffer(b"".join(v.texts[i] for i in usable), dtype=np.uint8)
        ends = np.cumsum([len(v.texts[i]) for i in usable])
        starts = np.concatenate([[0], ends[:-1]])
        self.inside = np.zeros((256, 256), dtype=bool)
        for i in usable:
            t = v.texts[i]
            for a, b in zip(t, t[1:]):
                self.inside[a, b] = True
        hashes = self.hasher.words(raw, starts, ends)
        order = np.argsort(hashes)
        self.piece_hash, self.piece_id = hashes[order], usable[order].astype(np.int32)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.longest = max((len(v.texts[i]) for i in usable), default=1)
        self.text_len = np.array([len(t) for t in v.texts], dtype=np.int64)
        self.text_start = np.cumsum(self.text_len) - self.text_len
        self.text_flat = np.frombuffer(b"".join(v.texts) or b"\0", dtype=np.uint8)
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.length, self.flat = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int32)
        hit = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if len(hit):
            at = np.minimum(np.searchsorted(self.piece_hash, h[hit]), len(self.piece_hash) - 1)
            out[hit] = np.where(self.piece_hash[at] == h[hit], self.piece_id[at], -1)
        return out

    def _cut_many(self, data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of n bytes, end to end, and how many each has."""
        m = len(starts)
        text = data[starts[:, None] + np.arange(n)]
        up, down = self.hasher.powers[V.BYTE_BASE].upto(n + 1)
        prefix = np.zeros((n + 1, m), dtype=np.uint64)
        np.cumsum((V.BYTE_CODES[text] * up[:n]).T, axis=0, out=prefix[1:])
        is_start = np.ones((n + 1, m), dtype=bool)
        is_start[:n] = ((text & 0xC0) != 0x80).T
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        back, piece = np.zeros((n + 1, m), dtype=np.int16), np.full((n + 1, m), -1, dtype=np.int32)
        unknown = self.stream.unknown
        for end in range(1, n + 1):
            known = np.zeros(m, dtype=bool)
            for start in range(max(0, end - self.longest), end):
                rows = np.flatnonzero((best[start] > -np.inf) & is_start[end])
                if not len(rows):
                    continue
                found = self._find(V.mix((prefix[end, rows] - prefix[start, rows]) * down[start]))
                ok = found >= 0
                rows, found = rows[ok], found[ok]
                score = best[start, rows] + self.v.scores[found]
                better = score > best[end, rows]
                rows, found = rows[better], found[better]
                best[end, rows], back[end, rows], piece[end, rows] = score[better], start, found
            # a character without a piece of its own
            for width in range(1, min(4, end) + 1):
                start = end - width
                rows = np.flatnonzero((best[start] > -np.inf) & is_start[start] & is_start[end] & ~known)
                if width > 1 and len(rows):
                    rows = rows[~is_start[start + 1 : end, rows].any(axis=0)]
                if not len(rows):
                    continue
                known[rows] = True
                rows = rows[self._find(V.mix((prefix[end, rows] - prefix[start, rows]) * down[start])) < 0]
                score = best[start, rows] + unknown
                better = score > best[end, rows]
                rows = rows[better]
                best[end, rows], back[end, rows], piece[end, rows] = score[better], start, -1
        out = np.full((m, n), -1, dtype=np.int32)
        at, slot = np.full(m, n, dtype=np.int64), np.full(m, n, dtype=np.int64)
        live = np.arange(m)
        while len(live):
            start, chosen = back[at[live], live].astype(np.int64), piece[at[live], live]
            whole = chosen >= 0
            rows = live[whole]
            slot[rows] -= 1
            out[rows, slot[rows]] = chosen[whole]
            for i in live[~whole]:
                a, b = int(back[at[i], i]), int(at[i])
                slot[i] -= b - a
                out[i, slot[i] : slot[i] + b - a] = self.v.byte_ids[text[i, a:b]]
            at[live] = start
            live = live[at[live] > 0]
        return out[out >= 0], n - slot

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        flats, lengths, order = [self.flat], [], []
        size = ends - starts
        for n in np.unique(size):
            these = np.flatnonzero(size == n)
            if n > LONG:
                for i in these:
                    ids = self.stream.feed(data[starts[i] : ends[i]].tobytes()) + self.stream.close()
                    flats.append(np.array(ids, dtype=np.int32))
                    lengths.append([len(ids)])
            else:
                for part in np.array_split(these, -(-len(these) * int(n) // 500_000) or 1):
                    ids, count = self._cut_many(data, starts[part], int(n))
                    flats.append(ids)
                    lengths.append(count)
            order.append(these)
        lengths, order = np.concatenate(lengths), np.concatenate(order)
        start = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate(flats)
        all_keys = np.concatenate([self.keys, keys[order]])
        sort = np.argsort(all_keys)
        self.keys, self.start, self.length = all_keys[sort], np.concatenate([self.start, start])[sort], np.concatenate([self.length, lengths])[sort]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice, end to end, and offsets of the documents in them."""
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], 32)  # the mark before a text's first word
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        new = np.ones(len(data), dtype=bool)
        new[1:] = ~self.inside[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        new[offsets[:-1][some]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))
        hashes = self.hasher.words(data, starts, ends)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), dtype=bool)
        if len(self.keys) + (~known).sum() > self.most:
            self.clear()
            known = np.zeros(len(unique), dtype=bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            self._learn(data, unique[fresh], starts[index[fresh]], ends[index[fresh]])
        at = np.searchsorted(self.keys, unique)[inverse]
        length = self.length[at]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(self.start[at] - total[:-1], length) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, end to end, with the mark before each text's first word."""
        length = self.text_len[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.text_flat[np.repeat(self.text_start[ids] - total[:-1], length) + np.arange(total[-1])]


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but text) of ``docs`` and ids array<int>, n_tokens, round_trip."""
    from pyspark.sql import types as T

    keep = keep if keep is not None else [c for c in docs.columns if c != "text"]
    names = apart(docs.select(*keep), "ids", "n_tokens", "round_trip")
    schema = T.StructType([T.StructField(names[c], docs.schema[c].dataType) for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.texts, vocabulary.scores, vocabulary.usable, vocabulary.byte_ids))  # plain values: a broadcast is read without this package

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            null = batch.column("_encoded").is_null()
            for row, end, data, offsets in V.slices(batch.column("_encoded"), 1 << 20):
                ids, at = encoder.encode(data, offsets)
                some = np.diff(offsets) > 0
                marked = np.insert(data, offsets[:-1][some], 32)
                decoded = encoder.decode(ids)
                ok = np.ones(end - row, dtype=bool)
                if not np.array_equal(decoded, marked):
                    edges = offsets + np.concatenate([[0], np.cumsum(some)])
                    ok = np.array([np.array_equal(encoder.decode(ids[at[i] : at[i + 1]]), marked[edges[i] : edges[i + 1]]) for i in range(end - row)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                absent = null.slice(row, end - row)
                if absent.true_count:
                    import pyarrow.compute as pc

                    lists = pc.if_else(absent, pa.scalar(None, pa.list_(pa.int32())), lists)
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns[:-1]), lists, pa.array(np.diff(at).astype(np.int64)), pa.array(ok)], names=schema.names)

    return docs.select(*[F.col(c).alias(names[c]) for c in keep], F.col("text").alias("_encoded")).mapInArrow(V.frugal(run), schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with ``text`` decoded from its column ids."""
    from pyspark.sql import types as T

    names = [c for c in encoded.columns if c != "text"]
    schema = T.StructType([encoded.schema[c] for c in names] + [T.StructField("text", T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.texts)

    def run(batches):
        import pyarrow as pa

        texts = shared.value
        for batch in batches:
            out = [None if ids is None else b"".join(texts[i] for i in ids).decode("utf-8", "replace")[1:] for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "text"])

    return encoded.select(*names).mapInArrow(V.frugal(run), schema)


def op4_sentencepiece(spark, sf_dir) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip for every document."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), load(), ["doc_id"])
