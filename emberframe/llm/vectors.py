"""Vectors as rows: validity, classes of equal vectors, and k-means on a bounded sample."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, by_value

by_value(__name__)


def tamed(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles, scaled by the power of two that brings them near 1."""
    most = np.abs(x).max(axis=1, initial=0)
    wild = (most > 1e100) | ((most < 1e-100) & (most > 0))
    if wild.any():
        x = x.copy()
        x[wild] = np.ldexp(x[wild], -np.frexp(most[wild])[1][:, None])
    return x


def usable(embeddings: DataFrame, directions: bool = False) -> DataFrame:
    """(vec_id, v) of the rows of ``embeddings`` (vec_id, embedding) that take part.

    ``v`` holds the vector as little-endian doubles; where only ``directions`` count, ``tamed``. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do those that have another length than most rows.
    """
    sizes = embeddings.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "d").first()
    d = top.d if top else 0

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = values.reshape(-1, d) + 0.0 if len(values) else np.zeros((0, d))
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = tamed(np.where(good[:, None], x, 0.0)) if directions else x
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(good)), pa.array([r.tobytes() for r in x[good]], pa.binary())], names=["vec_id", "v"])

    full = embeddings.where(F.size("embedding") == d).select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return full.mapInArrow(run, "vec_id long, v binary")


def classes(vectors: DataFrame, scratch: Scratch, ids: int, name: str = "classes") -> DataFrame:
    """(cid, v, n, ids): the distinct vectors of (vec_id, v), their rows' number and ``ids`` smallest ids.

    Every task keeps only the smallest ids of each vector before anything is shuffled, so a vector
    that a third of all rows share is a handful of rows.
    """

    def run(batches):
        held: dict[bytes, list] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entry = held.setdefault(v, [0, []])
                entry[0] += 1
                if i is not None:
                    if len(entry[1]) < ids:
                        heapq.heappush(entry[1], -i)
                    else:
                        heapq.heappushpop(entry[1], -i)
            if len(held) > 50_000:
                yield emit(held)
                held = {}
        yield emit(held)

    def emit(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array([e[0] for e in held.values()], pa.int64()), pa.array([[-i for i in e[1]] for e in held.values()], pa.list_(pa.int64()))],
            names=["v", "n", "ids"])

    parts = vectors.mapInArrow(run, "v binary, n long, ids array<long>")
    whole = parts.groupBy("v").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, ids).alias("ids"))
    return scratch.put(whole.withColumn("cid", F.monotonically_increasing_id()), name)


def sample(vectors: DataFrame, most: int, seed: int) -> np.ndarray:
    """About ``most`` rows of (v) at most, drawn by hash, as a matrix."""
    n = vectors.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("v")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1)))
    rows = vectors.where(draw).select("v").toPandas()["v"]
    x = np.frombuffer(b"".join(sorted(rows)), np.float64)
    return x.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of every row."""
    out, half = np.empty(len(x), np.int64), 0.5 * (centres**2).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (x[at : at + 4096] @ centres.T - half).argmax(1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, seed: int, balance: int = 0) -> np.ndarray:
    """Centres of ``x``; with ``balance``, clusters above that size are split, so sizes stay even."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = size > 0
        centres[full] = sums[full] / size[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    if balance:
        own = nearest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        more = [k_means(x[own == c], int(-(-size[c] // balance)), 4, seed + 1) for c in np.flatnonzero(size > balance)]
        centres = np.concatenate([centres[(size > 0) & (size <= balance)], *more])
    return np.unique(centres, axis=0)
