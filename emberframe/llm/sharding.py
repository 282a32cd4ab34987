"""Sharding by histogram sort: exact byte counts below probes, then one exchange."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import Scratch, by_value

by_value(__name__)

SIGN = 1 << 63
WIDE = 64


def _split(keys):
    """128-bit keys as the two unsigned halves (text hash, document id)."""
    mask = (1 << WIDE) - 1
    return np.array([k >> WIDE for k in keys], np.uint64), np.array([k & mask for k in keys], np.uint64)


def _unsigned(column):
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)


def _places(high, low, keys):
    """For each probe, how many of the sorted (high, low) pairs are below it."""
    kh, kl = _split(keys)
    left, right = np.searchsorted(high, kh, "left"), np.searchsorted(high, kh, "right")
    return np.array([a + np.searchsorted(low[a:b], x) for a, b, x in zip(left, right, kl)], np.int64)


def below(keyed: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) of ``keyed`` (h, k, size) with a key below each probe, over all partitions."""

    def count(batches):
        size, rows = np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64)
        for batch in batches:
            high, low = _unsigned(batch.column(0)), _unsigned(batch.column(1))
            order = np.lexsort((low, high))
            total = np.r_[0, np.cumsum(batch.column(2).to_numpy(zero_copy_only=False)[order])]
            at = _places(high[order], low[order], probes)
            size += total[at]
            rows += at
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(probes))), pa.array(size), pa.array(rows)], names=["i", "bytes", "rows"])

    found = keyed.select("h", "k", "size").mapInArrow(count, "i long, bytes long, rows long")
    got = {r.i: (r.bytes, r.rows) for r in found.groupBy("i").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()}
    return [got.get(i, (0, 0)) for i in range(len(probes))]


def find_splitters(keyed: DataFrame, ideal: list[float], slack: list[float], whole: float, fan: int = 16):
    """Keys that cut ``keyed`` near the byte counts ``ideal``, each within its ``slack``, with the (bytes, rows) below.

    Each round counts exact bytes below ``fan`` probes inside every open bracket and keeps the
    sub-bracket that holds the ideal place. Probes move on the text hash alone while that suffices;
    only inside a text of over ``whole`` bytes do they move on to document ids, so equal texts stay
    together. A bracket that no probe can split further gives its nearer end.
    """
    end = (1 << (2 * WIDE)) - 1
    total, rows, first, last = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.min("k"), F.max("k")).first()
    first, last = (first or 0) + SIGN, (last or 0) + SIGN + 1
    n = len(ideal) + 1
    low, high = [(0, 0, 0)] * (n - 1), [(end, total, rows)] * (n - 1)  # (key, bytes, rows)
    done: dict[int, tuple[int, int, int]] = {}
    while len(done) < n - 1:
        wanted: dict[int, list[int]] = {}
        for i in range(n - 1):
            if i in done:
                continue
            best = min(low[i], high[i], key=lambda x: abs(x[1] - ideal[i]))
            a, b = low[i][0], high[i][0]
            if abs(best[1] - ideal[i]) <= slack[i] or b - a <= 1 or high[i][2] - low[i][2] <= 1:
                done[i] = best
                continue
            ah, bh = (a >> WIDE) + 1, (b >> WIDE) + (b == end)
            if bh - ah >= 1:  # room between text hashes
                probes = sorted({ah + (bh - ah) * j // (fan + 1) for j in range(1, fan + 1)} | {ah})
                probes = [p << WIDE for p in probes if a < p << WIDE < b]
            else:
                probes = []
            within = a & ((1 << WIDE) - 1) or b != end and b & ((1 << WIDE) - 1)
            if not probes and (within or high[i][1] - low[i][1] > whole):  # inside the rows of one text
                top = a >> WIDE << WIDE
                c, d = max(a, top + first), min(b, top + last)
                probes = sorted({c, d} | {c + (d - c) * j // (fan + 1) for j in range(1, fan + 1)})
                probes = [p for p in probes if a < p < b]
            if probes:
                wanted[i] = probes
            else:
                done[i] = best
        keys = sorted({p for ps in wanted.values() for p in ps})
        if not keys:
            break
        counts = dict(zip(keys, below(keyed, keys)))
        for i in wanted:  # any counted probe may narrow any open bracket
            for k in keys:
                at = (k, *counts[k])
                if low[i][0] < k < high[i][0]:
                    if at[1] <= ideal[i]:
                        low[i] = at
                    else:
                        high[i] = at
    cuts = [done[i] for i in range(n - 1)]
    for i in range(1, n - 1):  # rounding to nearer ends never reorders boundaries
        cuts[i] = max(cuts[i], cuts[i - 1])
    return cuts


def fill(total: int, held: list[int]) -> list[float]:
    """What each shard still takes of ``total``, so that with what it holds all come as near to one level as can be."""
    order = sorted(held)
    for n in range(len(order), 0, -1):
        level = (total + sum(order[:n])) / n
        if level >= order[n - 1]:
            return [max(0.0, level - h) for h in held]
    return [total / len(held)] * len(held)


def shard_by_bytes(docs: DataFrame, scratch: Scratch, shards: int = 24, tolerance: float = 0.005, rows_per_task: int = 250_000) -> DataFrame:
    """Add size, shard and slot to ``docs``: shards of near-equal bytes, slots gapless from 0.

    Size is the UTF-8 length of the text (null: none) plus 8. Equal texts of up to a shard's bytes
    stay in one shard: those of over ``tolerance`` of a shard, at most shards / tolerance, are dealt
    first, the largest to the emptiest shard. All others are ordered by (hash of the text, doc_id)
    and cut at splitters found by ``find_splitters``, which fill the shards up to one level. Rows are
    exchanged once, by range within shard, so a shard of any size is spread over many tasks. Null
    ids sort first, ids that are no whole numbers by their hash; fully equal rows are interchangeable and may stay together. An empty table gives
    an empty result. Existing columns of the added names are replaced, no others are touched.
    """
    docs = docs.drop("size", "shard", "slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    number = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    keys = [
        (F.octet_length(text).cast("long") + 8).alias("size"), F.xxhash64(text).alias("h"), F.coalesce(number, F.lit(-(1 << 63))).alias("k")]
    keyed = scratch.put(docs.select(*keys), "keys")
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    coarse = min(64, max(4, math.ceil(rows / shards / rows_per_task)))
    sums = keyed.groupBy("h").agg(F.sum("size").alias("bytes")).where((F.col("bytes") > tolerance * total / shards) & (F.col("bytes") <= total / shards))
    held, home = [0] * shards, {}
    for r in sorted(sums.collect(), key=lambda r: (-r.bytes, r.h)):
        home[r.h] = held.index(min(held))
        held[home[r.h]] += r.bytes
    room = fill(total - sum(held), held)
    ideal = [sum(room[:j]) + room[j] * i / coarse for j in range(shards) for i in range(coarse)][1:]
    slack = [tolerance * total / shards if i % coarse == 0 else room[i // coarse] / coarse / 4 for i in range(1, shards * coarse)]
    rest = keyed.where(~F.col("h").isin(list(home))) if home else keyed
    bounds = [c[0] for c in find_splitters(rest, ideal, slack, total / shards)]
    large = np.array(sorted(home), np.int64)
    homes = np.array([home[h] for h in large.tolist()], np.int64)

    @F.pandas_udf("long")
    def part_of(h: pd.Series, k: pd.Series) -> pd.Series:
        hash_, id_ = h.to_numpy(np.int64), k.to_numpy(np.int64)
        high, low = (x.view(np.uint64) ^ np.uint64(SIGN) for x in (hash_, id_))
        bh, bl = _split(bounds)
        part = np.searchsorted(bh, high, "left").astype(np.int64)
        tied = np.searchsorted(bh, high, "right") > part
        for x in np.unique(high[tied]):  # boundaries inside the rows of one text, or at its start
            mine, edge = high == x, np.flatnonzero(bh == x)
            part[mine] = edge[0] + np.searchsorted(bl[edge], low[mine], "right")
        shard, within = part // coarse, part % coarse
        if len(large):
            at = np.minimum(np.searchsorted(large, hash_), len(large) - 1)
            own = large[at] == hash_
            mixed = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shard, within = np.where(own, homes[at], shard), np.where(own, coarse + mixed.astype(np.int64) % coarse, within)
        return pd.Series(shard * 2 * coarse + within)

    counts = np.zeros(shards * 2 * coarse, np.int64)
    for r in keyed.groupBy(part_of("h", "k").alias("part")).agg(F.count("*").alias("n")).collect():  # one row for each part
        counts[r.part] = r.n
    before = (np.cumsum(counts.reshape(shards, -1), axis=1) - counts.reshape(shards, -1)).ravel()
    dealt = docs.select(F.struct("*").alias("row"), *keys).withColumn("part", part_of("h", "k"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("h", "k")) - 1
    first = F.array(*(F.lit(int(x)).cast("long") for x in before))
    return dealt.select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns), "size", F.floor(F.col("part") / (2 * coarse)).cast("int").alias("shard"),
        (within + F.element_at(first, F.col("part").cast("int") + 1)).cast("long").alias("slot"),
    )
