"""SimHash near-duplicates by multi-index hashing over two fingerprint segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import Scratch, connected_components, by_value

by_value(__name__)

# The constants of XXH64 (fixed values).
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rot(x, n):
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def xxh64_slices(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every data[start:end], for all slices of one length at a time."""
    buffer = data + bytes(8)
    eight = np.ndarray(len(data) + 1, "<u8", buffer, strides=(1,))
    four = np.ndarray(len(data) + 5, "<u4", buffer, strides=(1,))
    one = np.frombuffer(buffer, np.uint8)
    out, lens, seed = np.empty(len(starts), np.uint64), ends - starts, np.uint64(seed)
    order = np.argsort(lens, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lens[order])) + 1) if len(order) else []:
        n, at = int(lens[group[0]]), starts[group].copy()
        left = n
        with np.errstate(over="ignore"):
            if n >= 32:
                acc = [np.full(len(at), v, np.uint64) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
                while left >= 32:
                    acc = [_round(v, eight[at + 8 * i]) for i, v in enumerate(acc)]
                    at += 32
                    left -= 32
                h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
                for v in acc:
                    h = (h ^ _round(np.uint64(0), v)) * P1 + P4
            else:
                h = np.full(len(at), seed + P5, np.uint64)
            h += np.uint64(n)
            while left >= 8:
                h = _rot(h ^ _round(np.uint64(0), eight[at]), 27) * P1 + P4
                at += 8
                left -= 8
            if left >= 4:
                h = _rot(h ^ (four[at].astype(np.uint64) * P1), 23) * P2 + P3
                at += 4
                left -= 4
            for _ in range(left):
                h = _rot(h ^ (one[at].astype(np.uint64) * P5), 11) * P1
                at += 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[group] = h ^ (h >> np.uint64(32))
    return out


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of ``sizes`` hashes each: a bit is 1 if set in over half of a run; an empty run has 0."""
    out, some = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(some):
        at = np.r_[0, np.cumsum(sizes[some])[:-1]]
        counts = np.zeros((len(some), 64), np.int64)
        for byte in range(8):  # a byte at a time bounds the unpacked bits
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, byte : byte + 1], axis=1, bitorder="little")
            counts[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        ones = (2 * counts > sizes[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def simhash(texts: list[str | None], words: int, seed: int) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if set in over half the shingle hashes; no words: 0."""
    parts, starts, ends, sizes, base = [], [], [], [], 0
    for text in texts:
        tokens = (text or "").encode().lower().split()
        joined = b" ".join(tokens)
        if tokens:
            lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
            end = np.cumsum(lens + 1) - 1
            begin, k = end - lens, min(words, len(tokens))
            starts.append(begin[: len(tokens) - k + 1] + base)
            ends.append(end[k - 1 :] + base)
            sizes.append(len(tokens) - k + 1)
        else:
            sizes.append(0)
        parts.append(joined)
        base += len(joined)
    sizes = np.array(sizes, np.int64)
    h = xxh64_slices(b"".join(parts), np.concatenate(starts), np.concatenate(ends), seed) if starts else np.zeros(0, np.uint64)
    return majority(h, sizes)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, text: str = "text", chunk: int = 1 << 21) -> DataFrame:
    """Add fp (long, the fingerprint's bits) to ``docs``; null and empty texts have fingerprint 0.

    Only A-Z are lower-cased; words are runs without ASCII white space.
    """
    docs = docs.drop("fp")
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts, begin, size = batch.column(at).to_pylist(), 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1] or "")
                if size < chunk and end < len(texts):
                    continue
                part = batch.slice(begin, end - begin)
                fp = simhash(texts[begin:end], words, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], names=[*part.schema.names, "fp"])
                begin, size = end, 0

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def _flips(column, bits, only_zero: bool):
    """The values one bit away from ``column``, or of them those that set a bit."""
    at = F.sequence(F.lit(0), F.lit(bits - 1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    if only_zero:
        at = F.filter(at, lambda i: column.bitwiseAND(bit(i)) == 0)
    return F.transform(at, lambda i: column.bitwiseXOR(bit(i)))


def near_pairs(fps: DataFrame, scratch: Scratch, longest: int = 512) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of ``fps`` (fp) within 2 bits of each other.

    Two fingerprints within 2 bits are equal in the low 32 bits, or at most 1 apart in the high 32.
    So a table on the low segment is probed with the exact value, and a table on the high segment
    with its ball of radius 1, of which only the values that set a bit are needed, as the other end
    of a pair reaches the rest. Fetched matches are verified over all 64 bits.

    A table entry that more than ``longest`` fingerprints share is not expanded into pairs: those
    fingerprints, and those that probe the entry, are linked through the values of their ball of
    radius 1 over all 64 bits. Two of them meet in such a value if and only if they are within 2
    bits, so linking each to the smallest that meets there loses no connection.
    """
    mask = F.lit(0xFFFFFFFF).cast("long")
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(mask)
    entry = lambda s, v: F.struct(F.lit(s).alias("seg"), v.alias("val"))
    table = fps.select("fp", F.explode(F.array(entry(0, high), entry(1, low))).alias("e")).select("fp", "e.*")
    long_ones = scratch.put(table.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > longest), "long")
    probes = fps.select("fp", F.explode(F.concat(
        F.array(entry(0, high), entry(1, low)), F.transform(_flips(high, 32, True), lambda v: entry(0, v)))).alias("e")).select("fp", "e.*")
    probes = probes.withColumnRenamed("fp", "f")
    if long_ones.isEmpty():
        hot = None
    else:
        hot = probes.join(long_ones, ["seg", "val"], "left_semi").select("f").distinct()
        table = table.join(long_ones, ["seg", "val"], "left_anti")
        probes = probes.join(long_ones, ["seg", "val"], "left_anti")
    apart = F.bit_count(F.col("f").bitwiseXOR(F.col("fp")))
    pairs = probes.join(table, ["seg", "val"]).where((F.col("f") != F.col("fp")) & (apart <= 2)).select(
        F.least("f", "fp").alias("a"), F.greatest("f", "fp").alias("b"))
    if hot is None:
        return pairs
    meets = hot.select("f", F.explode(F.concat(F.array("f"), _flips(F.col("f"), 64, False))).alias("val"))
    first = meets.groupBy("val").agg(F.min("f").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.union(meets.join(first, "val").where("a <> f").select("a", F.col("f").alias("b")).distinct())


def _body():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, body, fp, component, component_id) of every row of ``docs``; body is a hash of the text.

    component_id is the smallest doc_id reachable over links of 2 or fewer differing bits, component
    the smallest fingerprint. Rows with equal fingerprints (repeated rows, null and empty texts
    included) are one class and never expanded into pairs. A null doc_id takes part but is no
    component's smallest id, unless all of its component's are null.
    """
    rows = fingerprints(docs.select("doc_id", "text", _body().alias("body")), words, seed)
    marked = scratch.put(rows.select("doc_id", "body", "fp"), "fps")
    classes = scratch.put(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    group = connected_components(near_pairs(classes.select("fp"), scratch), scratch)
    named = classes.join(group, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(ids, "component").select(F.col("fp").alias("_fp"), "component", "component_id")
    return marked.join(final, F.col("fp") == F.col("_fp")).select("doc_id", "body", "fp", "component", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (nulls last), then body."""
    return keep_first(docs, near_duplicates(docs, scratch, words, seed), scratch)


def keep_first(docs: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with one row of each component of ``groups`` (doc_id, body, component), chosen as in ``keep_one``.

    Of rows of equal doc_id and text, which one stays is settled by a hash of the whole row. Columns of any name pass through.
    """
    key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), key("doc_id").alias("key"), "body"))
    first = scratch.put(groups.groupBy("component").agg(best.alias("b")).select("b.key", "b.body"), "first")
    packed = docs.select(F.struct(*docs.columns).alias("row"), key("doc_id").alias("key"), _body().alias("body"))
    kept = packed.join(first, ["key", "body"], "left_semi")
    one = Window.partitionBy("key", "body").orderBy(F.xxhash64(F.to_json("row")))
    return kept.withColumn("turn", F.row_number().over(one)).where("turn = 1").select("row.*")
