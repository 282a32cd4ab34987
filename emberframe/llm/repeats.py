"""Removal of repeated passages by a column-wise multi-document suffix construction.

Inserting one symbol of every document a round needs as many rounds as the longest document has
bytes, each rewriting the whole transform. So the collection is made of short pieces: every window
of ``length`` bytes belongs to the piece around its anchor (its leftmost smallest hashed gram), at
a place that its content alone decides. Equal windows therefore lie in pieces with the same core,
at the same column, and each round needs only the segment of the transform for suffixes of one
length, with the common prefixes of neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import Scratch, by_value

by_value(__name__)

LENGTH = 400  # bytes of a repeated string, unless a caller says otherwise
SPLIT = 8  # windows of a piece in a group of too many pieces
HOT = 64  # pieces of one core from which they are split
CROWD = 4096  # split pieces of one core from which windows are counted one by one
SEGMENT = 1 << 18  # bytes of a text that are hashed together


def gram_and_block(length: int) -> tuple[int, int]:
    """Bytes of a hashed gram, and windows of a piece (their bits fit a long, their core is half a window at least)."""
    return min(24, max(1, length // 6)), max(1, min(64, length // 2))

BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xBF58476D1CE4E5B9)


class Hasher:
    """64-bit polynomial hashes of all slices of a buffer, from one prefix sum."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def load(self, raw: np.ndarray) -> None:
        n = len(raw) + 1
        if len(self.power) < n:
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                values = np.full(n, base, np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: n - 1], out=self.sums[1:])

    def slices(self, starts, ends, salt=0) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts] + np.asarray(salt, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= MIX
        h ^= h >> np.uint64(32)
        return h * np.uint64(BASE)


def pieces(hasher: Hasher, texts: list[bytes], length: int):
    """Pieces of all windows of ``texts``: (text index, first start, first and last column, core hash, piece hash)."""
    gram, block = gram_and_block(length)
    lens = np.array([len(t) for t in texts], np.int64)
    offset = np.r_[0, np.cumsum(lens)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    hasher.load(raw)
    n = len(raw)
    at = np.arange(n - gram + 1)
    mask = np.uint64((1 << 32) - 1)  # high half: hash, low half: place; ties go to the leftmost
    best = hasher.slices(slice(0, n - gram + 1), slice(gram, n + 1)) & ~mask | at.astype(np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    anchor = (best & mask).astype(np.int64)
    valid = np.zeros(n - length + 1, bool)
    for begin, size in zip(offset[:-1].tolist(), lens.tolist()):
        if size >= length:
            valid[begin : begin + size - length + 1] = True
    start = np.flatnonzero(valid)
    anchor = anchor[start]
    part = (anchor - start) // block
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    s0, s1 = start[first], start[last]
    end = anchor[first] - block * part[first]  # the last start that the block could have
    i0, i1 = block - 1 - (end - s0), block - 1 - (end - s1)
    core = hasher.slices(end, end - block + 1 + length, part[first].astype(np.uint64) + np.uint64(1))
    whole = hasher.slices(s0, s1 + length, (i0 * 1000 + i1 + 7).astype(np.uint64))
    text = np.searchsorted(offset, s0, "right") - 1
    return text, s0 - offset[text], i0, i1, core.view(np.int64), whole.view(np.int64)


def find_pieces(texts: DataFrame, length: int, chunk: int = 1 << 19) -> DataFrame:
    """(key, ph, th, n, s0, i0, i1) of every piece of ``texts`` (th, n, text).

    A window's piece depends on the window alone, so a long text is hashed in segments of
    ``SEGMENT`` windows, which overlap by a window.
    """
    segment = SEGMENT

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            th, n, text = (batch.column(i).to_pylist() for i in range(3))
            th, size_of = np.array(th, np.int64), np.array(n, np.int32)

            def found(held):
                which, s0, i0, i1, key, ph = pieces(hasher, [h[2] for h in held], length)
                owner, first = np.array([h[0] for h in held])[which], np.array([h[1] for h in held])[which]
                return pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ph), pa.array(th[owner]), pa.array(size_of[owner]), *(pa.array(x.astype(np.int32)) for x in (s0 + first, i0, i1))],
                    names=["key", "ph", "th", "n", "s0", "i0", "i1"])

            held, size = [], 0
            for i in range(len(n)):
                body = text[i].encode() if n[i] >= length else b""
                for at in range(0, max(0, n[i] - length + 1), segment):
                    held.append((i, at, body[at : at + segment + length - 1]))
                    size += len(held[-1][2])
                    if size >= chunk:
                        yield found(held)
                        held, size = [], 0
            if held:
                yield found(held)

    return texts.select("th", "n", "text").mapInArrow(run, "key long, ph long, th long, n int, s0 int, i0 int, i1 int")


def cut_flanks(candidates: DataFrame, length: int) -> DataFrame:
    """(gkey, key, ph, at, i0, i1, flanks) of the pieces to compare in ``candidates`` (text, rows).

    The windows of a block share its core, so a piece is the core as one symbol between the bytes
    left and right of it. In a hot group each piece is cut into runs of ``SPLIT`` windows, whose
    longer cores tell most pieces apart.
    """
    block = gram_and_block(length)[1]

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            out: list[tuple] = []
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = text.encode()
                for r in rows:
                    first = r["s0"] - r["i0"]  # of the block; may lie before the text
                    for at in range(r["i0"] // SPLIT * SPLIT, r["i1"] + 1, SPLIT) if r["hot"] else (0,):
                        width = SPLIT if r["hot"] else block
                        f, i0, i1 = first + at, max(r["i0"] - at, 0), min(r["i1"] - at, width - 1)
                        z = f + width - 1
                        left = b"\0" * i0 + body[f + i0 : z]
                        right = body[f + length : f + i1 + length] + b"\0" * (width - 1 - i1)
                        gkey = r["key"]
                        if r["hot"]:
                            core = body[z : f + length]
                            hasher.load(np.frombuffer(core, np.uint8))
                            salt = np.uint64((r["key"] + at) & ((1 << 64) - 1))
                            gkey = int(hasher.slices(np.array([0]), np.array([len(core)]), salt).view(np.int64)[0])
                        out.append((gkey, r["key"], r["ph"], at if r["hot"] else -1, i0, i1, left + right))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["gkey", "key", "ph", "at", "i0", "i1", "flanks"])

    return candidates.select("text", "rows").mapInArrow(run, "gkey long, key long, ph long, at int, i0 int, i1 int, flanks binary")


def insert_columns(symbols: np.ndarray, window: int) -> np.ndarray:
    """For equally long pieces, one bit per column: does the window that starts there occur in another piece?

    Every round inserts one symbol per piece, from the last column to the first: the pieces stay
    sorted by the suffix inserted so far, ``symbols[order, column]`` is the round's segment of the
    transform, and the common prefixes of neighbours follow from those of the round before.
    """
    m, width = symbols.shape
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    bits = np.zeros(m, np.uint64)
    for column in range(width - 1, -1, -1):
        segment = symbols[order, column]
        rank = np.argsort(segment, kind="stable")
        same = np.flatnonzero(segment[rank][1:] == segment[rank][:-1]) + 1
        new = np.zeros(m + 1, np.int32)
        if len(same):
            ranges = np.stack([rank[same - 1] + 1, rank[same] + 1], axis=1).ravel()
            new[same] = np.minimum.reduceat(common, ranges)[::2] + 1
        order, common = order[rank], new
        if column < window:
            hit = np.flatnonzero(common[:m] >= window)
            flag = np.uint64(1) << np.uint64(column)
            bits[order[hit]] |= flag
            bits[order[hit - 1]] |= flag
    return bits


def count_windows(crowded: DataFrame) -> DataFrame:
    """(key, ph, bits) of ``crowded`` pieces: their windows are counted one by one, each as its core and its own flank bytes.

    Counts meet map-side, so a core that any number of pieces share is no single task's work.
    """
    own = F.struct(
        F.col("w"), F.expr("substring(flanks, w + 1, %d - w)" % (SPLIT - 1)).alias("left"), F.expr("substring(flanks, %d, w)" % SPLIT).alias("right"))
    each = crowded.withColumn("w", F.explode(F.sequence("i0", "i1"))).select("gkey", "key", "ph", "at", "w", own.alias("own"))
    again = each.groupBy("gkey", "own").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    bit = F.expr("shiftleft(1L, w + at)")
    return each.join(again, ["gkey", "own"]).groupBy("key", "ph").agg(F.bit_or(bit).alias("bits"))


def compare_pieces(flanks: DataFrame, block: int, scratch: Scratch, most: int = 40_000) -> DataFrame:
    """(key, ph, bits): the windows of each piece that occur in another one with the same core."""
    flanks = scratch.put(flanks, "flanks")
    crowds = scratch.put(flanks.where("at >= 0").groupBy("gkey").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("gkey"), "crowds")

    def solve(table: pa.Table):
        at = table.column("at").to_numpy()
        for hot in (False, True):
            part = table.filter(pa.array((at >= 0) == hot))
            if not part.num_rows:
                continue
            width = SPLIT if hot else block
            gkey, key, ph, at_, i0, i1 = (part.column(c).to_numpy() for c in ("gkey", "key", "ph", "at", "i0", "i1"))
            bytes_ = np.frombuffer(b"".join(part.column("flanks").to_pylist()), np.uint8).reshape(len(gkey), -1).astype(np.int32)
            column = np.arange(width - 1)
            bytes_[:, : width - 1][column < i0[:, None]] = 256  # outside the piece
            bytes_[:, width - 1 :][column >= i1[:, None]] = 256
            core = np.unique(gkey, return_inverse=True)[1].astype(np.int32)
            symbols = np.concatenate([bytes_[:, : width - 1], core[:, None], bytes_[:, width - 1 :]], axis=1)
            bits = insert_columns(symbols, width)
            mine = ((np.uint64(2) << i1.astype(np.uint64)) - np.uint64(1)) & ~((np.uint64(1) << i0.astype(np.uint64)) - np.uint64(1))
            bits = (bits & mine) << np.maximum(at_, 0).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ph), pa.array(bits.view(np.int64))], names=["key", "ph", "bits"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= most:  # all but the last group are complete
                gkey = held.column("gkey").to_numpy()
                cut = int(np.searchsorted(gkey, gkey[-1]))
                if cut:
                    yield from solve(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None:
            yield from solve(held)

    crowded = not crowds.isEmpty()
    rest = flanks.join(crowds, "gkey", "left_anti") if crowded else flanks
    bits = rest.repartition("gkey").sortWithinPartitions("gkey").mapInArrow(run, "key long, ph long, bits long")
    if crowded:
        bits = bits.union(count_windows(flanks.where("at >= 0").join(crowds, "gkey", "left_semi")))
    return bits.groupBy("key", "ph").agg(F.bit_or("bits").alias("bits"))


def whole_words(body: bytes, a: int, b: int) -> int:
    """Words of body[a:b]; one that goes on beyond either end does not count."""
    part = body[a:b]
    cut = int(a > 0 and not body[a - 1 : a].isspace() and not part[:1].isspace())
    return len(part.split()) - cut - int(b < len(body) and not body[b : b + 1].isspace() and not part[-1:].isspace())


def strip_windows(texts: DataFrame, length: int, min_words: int) -> DataFrame:
    """(th, n, n_removed, n_spans, kept) of ``texts`` (th, n, text, found): bytes under repeated windows go.

    A run of such bytes stays if it holds fewer than ``min_words`` whole words.
    """

    def run(batches):
        for batch in batches:
            out = []
            for th, n, text, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                edge = np.zeros(n + 1, np.int32)
                s = np.array([f["s0"] - f["i0"] for f in found], np.int64)
                bits = np.array([f["bits"] for f in found], np.int64).view(np.uint64)
                row, i = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                np.add.at(edge, s[row] + i, 1)
                np.add.at(edge, s[row] + i + length, -1)
                body, gone = text.encode(), np.cumsum(edge[:n]) > 0
                runs = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
                if min_words:
                    short = [whole_words(body, a, b) < min_words for a, b in runs.tolist()]
                    for a, b in runs[short].tolist():
                        gone[a:b] = False
                    runs = runs[~np.array(short, bool)]
                if len(runs):
                    out.append((th, n, int(gone.sum()), len(runs), np.frombuffer(body, np.uint8)[~gone].tobytes()))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["th", "n", "n_removed", "n_spans", "kept"])

    return texts.select("th", "n", "text", "found").mapInArrow(run, "th long, n int, n_removed long, n_spans long, kept binary")


def text_key(text="text"):
    """Columns that name a text: its hash and its bytes; null is empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return {"th": F.xxhash64(body), "n": F.octet_length(body)}


def repeated(docs: DataFrame, scratch: Scratch, length: int = LENGTH, min_words: int = 0) -> DataFrame:
    """(th, n, n_removed, n_spans, kept) of every distinct text of ``docs`` (text) that loses bytes.

    A byte goes if it lies in a string of ``length`` bytes that starts at another place too, in the
    same document or any other; rows of equal text are different documents. Runs of such bytes of
    fewer than ``min_words`` whole words stay. Texts are compared as UTF-8 bytes; null, empty and
    shorter texts lose nothing. What is left may break a character.

    Pieces that occur twice as a whole are settled by their count; only distinct pieces with a
    common core reach the construction, so a large group of copies costs no more than one.
    """
    texts = docs.select("text").where("text is not null").withColumns(text_key()).where(F.col("n") >= length)
    found = scratch.put(find_pieces(texts, length), "pieces")
    again = scratch.put(found.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "again")
    found = scratch.put(found.join(again, "key", "left_semi"), "candidates")
    scratch.drop("pieces")
    place = F.struct("th", "n", "s0")
    kinds = scratch.put(found.groupBy("key", "ph").agg(F.count("*").alias("c"), F.min(place).alias("rep")), "kinds")
    per_core = scratch.put(kinds.groupBy("key").agg(F.count("*").alias("d")), "cores")
    kinds = kinds.join(per_core, "key").select("key", "ph", "c", "d", "rep")
    rows = scratch.put(found.join(kinds, ["key", "ph"]).select(
        "th", "n", "key", "ph", "s0", "i0", "i1", (F.col("c") > 1).alias("whole"),
        ((F.col("d") > 1) & (F.col("c") == 1)).alias("open"),
        ((F.col("d") > 1) & (F.col("rep") == place)).alias("probe"), (F.col("d") > HOT).alias("hot")), "rows")
    scratch.drop("candidates")
    probes = rows.groupBy("th", "n").agg(F.collect_set(F.when(F.col("probe"), F.struct("key", "ph", "s0", "i0", "i1", "hot"))).alias("rows"))
    once = texts.groupBy("th", "n").agg(F.first("text").alias("text"))
    bodies = scratch.put(once.join(probes, ["th", "n"]), "bodies")
    flanks = cut_flanks(bodies.where(F.size("rows") > 0), length)
    bits = scratch.put(compare_pieces(flanks, gram_and_block(length)[1], scratch), "bits")
    scratch.drop("flanks")
    full = F.expr("~shiftleft(-2L, i1) & shiftleft(-1L, i0)")
    settled = rows.where("whole").select("th", "n", "s0", "i0", full.alias("bits")).union(
        rows.where("open").join(bits, ["key", "ph"]).where("bits <> 0").select("th", "n", "s0", "i0", "bits"))
    hits = settled.groupBy("th", "n").agg(F.collect_set(F.struct("s0", "i0", "bits")).alias("found"))
    return scratch.put(strip_windows(bodies.drop("rows").join(hits, ["th", "n"]), length, min_words), "stripped")


@F.pandas_udf(T.StringType())
def whole_characters(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))


def strip_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, min_words: int = 0) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; see ``repeated``.

    A character is dropped if any of its bytes is; a text of which nothing is left is empty. All
    other columns, whatever their names, and all rows stay as they are.
    """
    lost = repeated(docs, scratch, length, min_words)
    keyed = docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in text_key().items()))
    joined = keyed.join(lost.select("th", "n", "kept"), ["th", "n"], "left")
    left = F.when(F.col("kept").isNotNull(), whole_characters("kept")).otherwise(F.col("row.text"))
    return joined.select(*(left.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
