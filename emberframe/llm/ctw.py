"""Language-model scores by context-tree weighting over bytes, and a word-unigram base."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import Scratch, by_value
from emberframe.llm.simhash import xxh64_slices

by_value(__name__)

END = b"\n"  # no word holds it: it closes a text, and stands for whatever precedes its first byte
GRAM, WORD_HASH = 0, 1
ROOT = 3  # contexts of so many bytes are roots of the subtrees that one task solves whole
HALF = math.log(0.5)


def normal(text: str | None) -> bytes:
    """The scored form of a text: A-Z lower-cased, words joined by one space, then the end."""
    return b" ".join((text or "").encode().lower().split()) + END


class Chunk:
    """Normal forms of some texts in one buffer, each behind ``depth`` end bytes."""

    def __init__(self, texts, depth: int):
        forms = [normal(t) for t in texts]
        pad = END * depth
        self.depth, self.data = depth, pad + pad.join(forms)
        self.raw = np.frombuffer(self.data, np.uint8)
        self.lens = np.array([len(f) for f in forms], np.int64)
        self.first = np.r_[0, np.cumsum(self.lens)]  # index of each text's first predicted byte
        gap = (self.raw == 32) | (self.raw == 10)
        self.word_start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.word_end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        starts = self.first[:-1] + depth * np.arange(1, len(forms) + 1)
        self.word_text = np.searchsorted(starts, self.word_start, "right") - 1

    def grams(self, size: int = 1 << 20):
        """(text, gram) of every predicted byte, about ``size`` at a time.

        A gram is one number: the context bytes, the latest first, then the predicted byte.
        """
        for at in range(0, int(self.first[-1]), size):
            index = np.arange(at, min(at + size, int(self.first[-1])))
            owner = np.searchsorted(self.first, index, "right") - 1
            place = index + self.depth * (owner + 1)
            code = np.zeros(len(index), np.int64)
            for back in [*range(1, self.depth + 1), 0]:
                code = code << 8 | self.raw[place - back]
            yield owner, code

    def word_hashes(self) -> np.ndarray:
        return xxh64_slices(self.data, self.word_start, self.word_end, 0).view(np.int64)


def chunks(texts, size: int):
    """(begin, end) of runs of about ``size`` characters."""
    begin = held = 0
    for end, text in enumerate(texts, 1):
        held += len(text or "") + 1
        if held >= size or end == len(texts):
            yield begin, end
            begin, held = end, 0


def summed(keys: list, counts: list):
    """Sorted distinct keys with the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Counts:
    """Sums by key that take in parts and merge them as they pile up."""

    def __init__(self):
        self.keys, self.counts, self.loose = [], [], 0

    def add(self, keys, counts) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.loose += len(keys)
        if len(self.keys) > 1 and self.loose > 1 << 20 and self.loose > 2 * len(self.keys[0]):
            self.merged()

    def merged(self):
        if len(self.keys) != 1:
            none = np.zeros(0, np.int64)
            keys, counts = summed([none, *self.keys], [none, *self.counts])
            self.keys, self.counts = [keys], [counts]
        self.loose = 0
        return self.keys[0], self.counts[0]


def part_of(kind: int, keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """Part of each key: words by themselves, grams by the latest ``ROOT`` bytes of their context."""
    head = keys >> 8 * (depth + 1 - min(ROOT, depth)) if kind == GRAM else keys
    return ((head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes first: sorted keys and small counts shrink to a quarter."""
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(blob, many: int, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(blob.as_py(), many * size, codec="zstd", asbytes=True) if many else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, many).T).view(kind).ravel()


def gather(docs: DataFrame, depth: int, parts: int, block: int, size: int = 1 << 20) -> DataFrame:
    """``docs`` (row, text, train) in blocks, with the grams and words of each block.

    A task's rows form blocks of about ``block`` bytes. Result rows hold either a ``row`` of a block,
    or, for one block, kind and part, the ``many`` distinct ``keys`` in the block's whole texts and how
    often they occur in its training texts, both packed.
    """

    def run(batches):
        task, number, taken = TaskContext.get().partitionId() << 20, 0, 0
        found = {GRAM: Counts(), WORD_HASH: Counts()}
        shape = None

        def emit():
            for kind, counts in found.items():
                keys, n = counts.merged()
                if not len(keys):
                    continue
                part = part_of(kind, keys, depth, parts)
                order = np.argsort(part, kind="stable")
                there, first = np.unique(part[order], return_index=True)
                m = len(there)
                mine = [(keys[i], n[i]) for i in np.split(order, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, task + number)), pa.nulls(m, shape), pa.array(np.full(m, kind, np.int32)), pa.array(there.astype(np.int32)),
                     pa.array([len(k) for k, _ in mine], pa.int32()), *(pa.array([pack(x[j]) for x in mine], pa.binary()) for j in (0, 1))],
                    names=["block", "row", "kind", "part", "many", "keys", "n"])
                found[kind] = Counts()

        for batch in batches:
            shape = batch.schema.field(0).type
            texts, train = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), bool)
            for begin, end in chunks(texts, size):
                chunk, learns = Chunk(texts[begin:end], depth), train[begin:end]
                for owner, code in chunk.grams(size):
                    for seen in (True, False):
                        keys, n = np.unique(code[learns[owner] == seen], return_counts=True)
                        found[GRAM].add(keys, n * seen)
                hashes = chunk.word_hashes()
                for seen in (True, False):
                    keys, n = np.unique(hashes[learns[chunk.word_text] == seen], return_counts=True)
                    found[WORD_HASH].add(keys, n * seen)
                m = end - begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, task + number)), batch.column(0).slice(begin, m), *(pa.nulls(m, pa.int32()) for _ in range(3)),
                     pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=["block", "row", "kind", "part", "many", "keys", "n"])
                taken += len(chunk.data)
                if taken >= block:
                    yield from emit()
                    number, taken = number + 1, 0
        yield from emit()

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("row", docs.schema["row"].dataType), *(T.StructField(c, T.IntegerType()) for c in ("kind", "part", "many")),
        T.StructField("keys", T.BinaryType()), T.StructField("n", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def add_up(found: DataFrame) -> DataFrame:
    """(kind, part, many, keys, n, total, known): all distinct keys of each part, sorted, with their counts over all blocks.

    Parts are folded block by block; a part holds no more than its own distinct keys.
    """

    def run(batches):
        held, at = Counts(), None

        def emit():
            keys, n = held.merged()
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int32()) for x in (*at, len(keys))), pa.array([pack(keys)]), pa.array([pack(n)]), pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])],
                names=["kind", "part", "many", "keys", "n", "total", "known"])

        for batch in batches:
            kinds, numbers, many = (batch.column(i).to_pylist() for i in range(3))
            for i, new in enumerate(zip(kinds, numbers)):
                if at is not None and new != at:
                    yield emit()
                    held = Counts()
                at = new
                held.add(*(unpack(batch.column(j)[i], many[i]) for j in (3, 4)))
        if at is not None:
            yield emit()

    dealt = found.select("kind", "part", "many", "keys", "n").repartition("kind", "part").sortWithinPartitions("kind", "part")
    return dealt.mapInArrow(run, "kind int, part int, many int, keys binary, n binary, total long, known long")


def log_gamma(x):
    """ln Gamma for x >= 0.5, by Stirling's series after a shift."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(a, b):
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


class Nodes:
    """Decision nodes of one depth and bit: counts, weighted probability, weight of the own estimate."""

    def __init__(self, zero, one, below=None):
        self.zero, self.one = zero, one
        own = log_kt(zero, one)
        self.log_weighted = own if below is None else np.logaddexp(HALF + own, HALF + below)
        self.stay = np.ones_like(own) if below is None else np.exp(HALF + own - self.log_weighted)
        self.p = (one + 0.5) / (zero + one + 1.0)
        self.seen = zero + one > 0


def mixed(q, seen, stay, p):
    """Probability of a one at a node, given ``q`` at its child; a child without counts leaves the node's own estimate."""
    return np.where(seen, stay * p + (1 - stay) * q, p)


class Subtrees:
    """Weighted context subtrees below all contexts of ``root`` bytes in some sorted grams with counts.

    At a node the weighted probability is half its own estimate and half the product over its
    children, for each of the binary decisions of a byte; the deepest nodes have their estimate
    alone. ``tops`` gives what the nodes above need, ``scores`` each gram's probability.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.keys, self.depth, self.root = keys, depth, min(ROOT, depth)
        rows, counts, self.up = {depth: keys}, {depth: n.astype(np.float64)}, {}
        for d in range(depth - 1, self.root - 1, -1):
            shorter = rows[d + 1] >> 16 << 8 | rows[d + 1] & 255
            rows[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            counts[d] = np.bincount(self.up[d + 1], weights=counts[d + 1], minlength=len(rows[d]))
        self.rows, self.counts = rows, counts

    def bit(self, b: int):
        """(nodes, node of each row) by depth, for the decisions on bit ``b``; the nodes' codes at the root."""
        nodes, of_row, first = {}, {}, {}
        for d in range(self.depth, self.root - 1, -1):
            code = self.rows[d] >> (8 - b)
            new = np.r_[True, code[1:] != code[:-1]]
            first[d], of_row[d] = np.flatnonzero(new), np.cumsum(new) - 1
            one = np.where(self.rows[d] >> (7 - b) & 1, self.counts[d], 0.0)
            ones, total = np.add.reduceat(one, first[d]), np.add.reduceat(self.counts[d], first[d])
            below = None
            if d < self.depth:
                parent = of_row[d][self.up[d + 1][first[d + 1]]]
                below = np.bincount(parent, weights=nodes[d + 1].log_weighted, minlength=len(first[d]))
            nodes[d] = Nodes(total - ones, ones, below)
        return nodes, of_row, code[first[self.root]]

    def tops(self):
        """(context of root - 1 bytes << 8 | decision, zeros, ones, summed ln of the weighted probabilities)."""
        for b in range(8):
            nodes, _, code = self.bit(b)
            r = nodes[self.root]
            context, decision = code >> b >> 8, (1 << b) | (code & ((1 << b) - 1))
            at, inverse = np.unique(context << 8 | decision, return_inverse=True)
            yield at, *(np.bincount(inverse, weights=w) for w in (r.zero, r.one, r.log_weighted))

    def scores(self, top: "Top") -> np.ndarray:
        """log10 probability of every gram's byte, all depths mixed."""
        out, byte = np.zeros(len(self.keys), np.float64), self.keys & 255
        for b in range(8):
            nodes, of_row, _ = self.bit(b)
            at, row = of_row[self.depth], np.arange(len(self.keys))
            q, seen = nodes[self.depth].p[at], nodes[self.depth].seen[at]
            for d in range(self.depth - 1, self.root - 1, -1):
                row = self.up[d + 1][row]
                at = of_row[d][row]
                q, seen = mixed(q, seen, nodes[d].stay[at], nodes[d].p[at]), nodes[d].seen[at]
            decision = (1 << b) | byte >> (8 - b)
            for d in range(self.root - 1, -1, -1):
                context = self.keys >> 8 * (self.depth + 1 - d)
                stay, p, known = top.find(d, context << 8 | decision)
                q, seen = mixed(q, seen, stay, p), known
            out += np.log10(np.where(byte >> (7 - b) & 1, q, 1 - q))
        return out


class Top:
    """Decision nodes of the contexts shorter than the subtrees' roots: at most 65,793 contexts at any size of the corpus."""

    def __init__(self, levels):
        self.levels = levels  # by depth: sorted codes, stay, p

    @classmethod
    def of(cls, codes, zero, one, below, depth: int) -> Top:
        levels = []
        for _ in range(depth + 1):
            order = np.argsort(codes)
            codes, zero, one, below = codes[order], zero[order], one[order], below[order]
            nodes = Nodes(zero, one, below)
            levels.append((codes, nodes.stay, nodes.p))
            codes, inverse = np.unique(codes >> 16 << 8 | codes & 255, return_inverse=True)
            zero, one, below = (np.bincount(inverse, weights=w, minlength=len(codes)) for w in (zero, one, nodes.log_weighted))
        return cls(levels[::-1])

    def find(self, depth: int, codes):
        """(stay, p, known) of decision nodes; an unknown one has the estimate of no counts."""
        have, stay, p = self.levels[depth]
        if not len(have):
            return np.ones(len(codes)), np.full(len(codes), 0.5), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(have, codes), len(have) - 1)
        known = have[at] == codes
        return np.where(known, stay[at], 1.0), np.where(known, p[at], 0.5), known


def fit_top(grams: DataFrame, depth: int) -> Top:
    """The tree's top from the summed grams (many, keys, n) of all parts."""

    def run(batches):
        for batch in batches:
            for i, many in enumerate(batch.column(0).to_pylist()):
                keys, n = unpack(batch.column(1)[i], many), unpack(batch.column(2)[i], many)
                some = n > 0
                if some.any():
                    for columns in Subtrees(keys[some], n[some], depth).tops():
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["code", "zero", "one", "below"])

    tops = grams.select("many", "keys", "n").mapInArrow(run, "code long, zero double, one double, below double")
    sums = tops.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("zero", "one", "below"))).toPandas()
    return Top.of(*(sums[c].to_numpy() for c in ("code", "zero", "one", "below")), min(ROOT, depth) - 1)


def values_of(found: DataFrame, sums: DataFrame, top, depth: int) -> DataFrame:
    """(block, kind, many, keys, value), packed: of every block's keys, a gram's log10 probability or a word's training count.

    A part's sums come first and are solved once; then its blocks pass by, one at a time.
    """

    def run(batches):
        model, at, keys, value = Top(top.value), None, None, None
        for batch in batches:
            kinds, numbers, blocks, many = (batch.column(i).to_pylist() for i in range(4))
            for i, (kind, part, block) in enumerate(zip(kinds, numbers, blocks)):
                mine = unpack(batch.column(4)[i], many[i])
                if block is None:
                    n = unpack(batch.column(5)[i], many[i])
                    at, keys = (kind, part), mine
                    value = n.astype(np.float64) if kind == WORD_HASH else Subtrees(keys, n, depth).scores(model).astype(np.float32)
                    continue
                assert at == (kind, part)
                got = pack(value[np.searchsorted(keys, mine)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([many[i]], pa.int32()), batch.column(4).slice(i, 1), pa.array([got])],
                    names=["block", "kind", "many", "keys", "value"])

    first = sums.select("kind", "part", F.lit(None).cast("long").alias("block"), "many", "keys", "n")
    then = found.select("kind", "part", "block", "many", "keys", F.lit(None).cast("binary").alias("n"))
    dealt = first.unionByName(then).repartition("kind", "part").sortWithinPartitions("kind", "part", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(run, "block long, kind int, many int, keys binary, value binary")


class Lookup:
    """Values of int64 keys in an open-addressing table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32)
        self.values = values
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):  # of those that meet at a free slot, one stays
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]
            won = free & (self.at[slot] == todo)
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all in the table."""
        slot = self._slot(keys)
        on = np.flatnonzero(self.keys[slot] != keys)
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            on = on[self.keys[slot[on]] != keys[on]]
        return self.values[self.at[slot]]


def score_blocks(rows: DataFrame, values: DataFrame, depth: int, size: int = 1 << 20) -> DataFrame:
    """(row, n_tokens, known, n_bytes, base, score) of every text: its block's values come first, then its rows."""
    kind_of_row = rows.schema["row"]
    at = [f.name for f in kind_of_row.dataType.fields].index("text")

    def run(batches):
        held, tables, now = {GRAM: [], WORD_HASH: []}, {}, None
        for batch in batches:
            blocks, kinds, many = (batch.column(i).to_pylist() for i in (0, 2, 3))
            begin = 0
            while begin < len(blocks):
                if blocks[begin] != now:
                    held, tables, now = {GRAM: [], WORD_HASH: []}, {}, blocks[begin]
                if kinds[begin] is not None:
                    kind = kinds[begin]
                    held[kind].append((unpack(batch.column(4)[begin], many[begin]), unpack(batch.column(5)[begin], many[begin], np.float32 if kind == GRAM else np.float64)))
                    begin += 1
                    continue
                end = begin
                while end < len(blocks) and blocks[end] == now and kinds[end] is None:
                    end += 1
                if not tables:
                    none = (np.zeros(0, np.int64), np.zeros(0, np.float32))
                    tables = {kind: Lookup(*map(np.concatenate, zip(none, *parts))) for kind, parts in held.items()}
                    held = {}
                texts = batch.column(1).slice(begin, end - begin).field(at).to_pylist()
                for a, b in chunks(texts, size):
                    chunk = Chunk(texts[a:b], depth)
                    total = np.zeros(b - a)
                    for owner, code in chunk.grams(size):
                        total += np.bincount(owner, weights=tables[GRAM].of(code), minlength=b - a)
                    n = tables[WORD_HASH].of(chunk.word_hashes())
                    sums = [np.bincount(chunk.word_text, weights=w, minlength=b - a) for w in (np.ones(len(n)), n > 0, np.log10(n + 1.0))]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).slice(begin + a, b - a), pa.array(sums[0].astype(np.int64) + 1), pa.array(sums[1].astype(np.int64)), pa.array(chunk.lens), pa.array(sums[2]), pa.array(total)],
                        names=["row", "n_tokens", "known", "n_bytes", "base", "score"])
                begin = end

    none = lambda kind: F.lit(None).cast(kind)
    first = values.select("block", none(kind_of_row.dataType).alias("row"), "kind", "many", "keys", "value")
    then = rows.select("block", "row", none("int").alias("kind"), none("int").alias("many"), none("binary").alias("keys"), none("binary").alias("value"))
    dealt = first.unionByName(then).repartition("block").sortWithinPartitions("block", F.col("kind").asc_nulls_last())
    out = [T.StructField(k, t()) for k, t in (("n_tokens", T.LongType), ("known", T.LongType), ("n_bytes", T.LongType), ("base", T.DoubleType), ("score", T.DoubleType))]
    return dealt.mapInArrow(run, T.StructType([kind_of_row, *out]))


def score(docs: DataFrame, train, scratch: Scratch, depth: int = 6, block: int = 32 << 20, parts: int | None = None) -> DataFrame:
    """``docs`` + n_tokens, n_known, train_tokens, n_bytes, base_score, score, bits_per_byte.

    ``score`` is the base-10 log-probability of the whole text in its normal form (null: empty)
    under a context tree of ``depth`` bytes, at most 6, of the rows where ``train`` holds; every
    context that they hold is a node. ``base_score`` is that of a word unigram with add-one
    smoothing. A context that training texts never show before a decision has no estimate: the
    longest shown one decides. Words are told apart by 64-bit hashes. Existing columns of the added
    names are replaced; without training rows, bytes are uniform and the base is 0.

    Texts are read in blocks of about ``block`` bytes. Only a block's distinct grams travel: to the
    part that holds their subtree, and back with their probability. ``parts`` follows the input's
    partitions, up to 4,096.
    """
    added = ("n_tokens", "n_known", "train_tokens", "n_bytes", "base_score", "score", "bits_per_byte")
    docs = docs.drop(*added)
    learns = F.coalesce(train, F.lit(False))
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), learns.alias("train"))
    parts = parts or min(4096, max(16, docs.rdd.getNumPartitions()))
    n_texts = docs.where(learns).count()
    read = scratch.put(gather(packed, depth, parts, block), "blocks")
    rows, found = read.where("kind is null"), read.where("kind is not null")
    sums = scratch.put(add_up(found), "sums")
    total, distinct = sums.where(F.col("kind") == WORD_HASH).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    total, kinds = total + n_texts, distinct + (n_texts > 0)
    top = docs.sparkSession.sparkContext.broadcast(fit_top(sums.where(F.col("kind") == GRAM), depth).levels)
    out = score_blocks(rows, values_of(found, sums, top, depth), depth)
    each = math.log10(total + kinds + 1)
    return out.select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns), "n_tokens",
        (F.col("known") + F.lit(int(n_texts > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), "n_bytes",
        (F.col("base") + F.lit(math.log10(n_texts + 1)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        "score", (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
