"""Byte-level BPE by length-bucketed padded matrices."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberframe.llm.common import by_value

by_value(__name__)

NONE = np.int64(1 << 40)
MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merger:
    """Merges of one vocabulary: a hashed pair table over numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = a << 32 | b
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # linear probing: of those that meet at a free slot, one stays
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]
            won = free & (self.keys[slot] == keys[todo])
            self.ranks[slot[won]] = r[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)
        top = max(ranks.values()) + 1
        # A merge may take all its places in one round if no pair with its result ranks before it.
        self.calm = np.ones(top, bool)
        self.calm[a[a > r]] = False
        self.calm[b[b > r]] = False

    def plain(self) -> tuple:
        """The tables as arrays, which travel without this class."""
        return self.single, self.keys, self.ranks, self.bits, self.calm

    @classmethod
    def of(cls, plain: tuple) -> Merger:
        merger = cls.__new__(cls)
        merger.single, merger.keys, merger.ranks, merger.bits, merger.calm = plain
        return merger

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a, b):
        """Rank of each pair (a, b), or NONE; negative ids are padding."""
        out = np.full(a.shape, NONE, np.int64)
        at = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        keys = a.ravel()[at] << 32 | b.ravel()[at]
        slot, flat = self._slot(keys), out.ravel()
        while len(at):
            found = self.keys[slot]
            hit = found == keys
            flat[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found >= 0)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(a.shape)

    def _block(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of similar length: one padded matrix, one round of merges at a time."""
        lens = np.array([len(w) for w in words])
        cells = np.full((len(words), lens.max()), -1, np.int64)
        cells[np.arange(lens.max()) < lens[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        out: list[np.ndarray] = [None] * len(words)
        rows = np.arange(len(words))
        while True:
            ranks = self.rank_of(cells[:, :-1], cells[:, 1:]) if cells.shape[1] > 1 else np.full((len(rows), 1), NONE)
            first = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), first]
            for i in np.flatnonzero(best == NONE):
                out[rows[i]] = cells[i][cells[i] >= 0]
            live = best < NONE
            if not live.any():
                return out
            rows, cells, ranks, first, best = rows[live], cells[live], ranks[live], first[live], best[live]
            take = ranks == best[:, None]
            column = np.arange(take.shape[1])
            start = np.where(take & ~np.pad(take, ((0, 0), (1, 0)))[:, :-1], column, -1)
            take &= (column - np.maximum.accumulate(start, axis=1)) % 2 == 0  # overlapping places: every other one
            take &= self.calm[best][:, None] | (column == first[:, None])
            cells[:, :-1][take] = np.broadcast_to(best[:, None], take.shape)[take]
            keep = cells >= 0
            keep[:, 1:] &= ~take
            new = np.full((len(rows), int(keep.sum(axis=1).max())), -1, np.int64)
            new[np.nonzero(keep)[0], (np.cumsum(keep, axis=1) - 1)[keep]] = cells[keep]
            cells = new

    def encode(self, words: list[bytes], block: int = 1 << 20) -> list[np.ndarray]:
        """Ids of each word; words are handled in buckets of doubling length."""
        out: list[np.ndarray] = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            buckets.setdefault(max(0, len(w) - 1).bit_length(), []).append(i)
        for power, members in buckets.items():
            step = max(1, block >> power)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._block([words[j] for j in part])):
                    out[i] = ids
        return out


def encode_texts(docs: DataFrame, vocab: str, pattern: str, text: str = "text", chunk: int = 1 << 20, cache: int = 300_000) -> DataFrame:
    """Add ids (little-endian unsigned 32-bit, as binary), n_tokens and decoded (binary) to ``docs``.

    Every match of ``pattern`` is encoded by itself with the ranks in the file ``vocab``, which the
    driver reads; its tables, of the vocabulary's size, are broadcast. There are no special tokens; ``decoded`` is made from the ids. Whole texts are encoded, in groups of about
    ``chunk`` characters per matrix pass; null and empty texts give no ids. A task keeps the ids of
    up to ``cache`` distinct matches and forgets them all when there are more. Existing columns of
    the added names are replaced.
    """
    docs = docs.drop("ids", "n_tokens", "decoded")
    at = docs.columns.index(text)
    schema = T.StructType(docs.schema.fields + [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())])

    ranks = read_ranks(vocab)
    sent = docs.sparkSession.sparkContext.broadcast((Merger(ranks).plain(), {r: t for t, r in ranks.items()}))

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        plain, piece = sent.value
        merger = Merger.of(plain)
        known: dict[str, bytes] = {}

        def some(texts):
            found = [find(t) if t else [] for t in texts]
            if len(known) > cache:
                known.clear()
            new = list(set().union(*found) - known.keys())
            for word, ids in zip(new, merger.encode([w.encode() for w in new])):
                known[word] = ids.astype("<u4").tobytes()
            return [b"".join(map(known.__getitem__, words)) for words in found]

        for batch in batches:
            texts, begin, size = batch.column(at).to_pylist(), 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1] or "")
                if size < chunk and end < len(texts):
                    continue
                ids = some(texts[begin:end])
                back = [b"".join(map(piece.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(back, pa.binary())],
                    names=[*part.schema.names, "ids", "n_tokens", "decoded"])
                begin, size = end, 0

    return docs.mapInArrow(run, schema)
