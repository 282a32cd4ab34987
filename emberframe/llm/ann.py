"""Nearest neighbours by largest inner product over balanced posting lists."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, by_value
from emberframe.llm.vectors import classes, k_means, sample, tamed, usable

by_value(__name__)


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T))


@dataclass
class Lists:
    """Balanced centres, and a graph that links each to its nearest others."""

    centres: np.ndarray
    graph: np.ndarray
    longest: float  # norm; one more component brings all vectors to it

    @classmethod
    def fit(cls, x: np.ndarray, longest: float, total: int, per_list: int, most_lists: int, degree: int, seed: int) -> Lists:
        x = lift(x, longest)
        want = max(1, min(most_lists, total // per_list, len(x) // 8))
        centres = k_means(x, want, 6, seed, balance=max(8, 2 * len(x) // want))
        apart = _distances(centres, centres)
        near = np.argsort(apart, axis=1, kind="stable")[:, 1 : degree + 1]
        far = np.stack([np.roll(np.arange(len(centres)), 1), np.roll(np.arange(len(centres)), -1)], axis=1)
        return cls(centres, np.concatenate([near, far], axis=1), longest)  # the ring keeps the graph in one part

    def assign(self, x: np.ndarray, slack: float, copies: int) -> np.ndarray:
        """Lists of each row: the nearest, and for boundary rows others nearly as near in new directions."""
        far = _distances(x, self.centres)
        order = np.argsort(far, axis=1, kind="stable")[:, : 4 * copies]
        out = np.zeros(far.shape, bool)
        rows = np.arange(len(x))
        kept = np.full((len(x), copies), -1)
        held = np.zeros(len(x), np.int64)
        for place in range(order.shape[1]):
            c = order[:, place]
            ok = (far[rows, c] <= (1 + slack) * far[rows, order[:, 0]]) & (held < copies)
            for s in range(copies):  # a list next to one already chosen adds little
                old = kept[:, s]
                close = np.linalg.norm(self.centres[c] - self.centres[np.maximum(old, 0)], axis=1)
                ok &= (old < 0) | (close >= 0.5 * far[rows, c])
            out[rows[ok], c[ok]] = True
            kept[rows[ok], held[ok]] = c[ok]
            held += ok
        return out

    def search(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Lists within ``ratio`` times the least distance of each query, found by walking the graph best first."""
        n, k = len(q), len(self.centres)
        far, opened = np.full((n, k), np.inf), np.zeros((n, k), bool)
        rows, start = np.arange(n), np.linspace(0, k - 1, min(k, 16)).astype(int)
        far[:, start] = _distances(q, self.centres[start])
        live = rows
        while len(live):
            open_ = np.where(opened[live], np.inf, far[live])
            best = open_.argmin(1)
            go = open_[np.arange(len(live)), best] <= ratio * np.maximum(far[live].min(1), 1e-9 * self.longest)
            live, best = live[go], best[go]
            opened[live, best] = True
            near = self.graph[best]
            step = np.linalg.norm(self.centres[near] - q[live][:, None, :], axis=2)
            np.put_along_axis(far_live := far[live], near, step, axis=1)
            far[live] = far_live
        return far <= ratio * np.maximum(far.min(1), 1e-9 * self.longest)[:, None]

    def reach(self, x: np.ndarray, k: int, recall: float, slack: float, copies: int, asked: int = 256, seed: int = 9) -> float:
        """The ratio for ``search`` at which ``asked`` rows of the sample ``x`` meet that share of their ``k`` nearest in it.

        Neighbours in a sample lie farther away than those in the whole table, so the share met
        there is no smaller, as far as the sample is like the table.
        """
        k = min(k, len(x) - 1)
        if k < 1:
            return 1.0
        drawn = np.random.default_rng(seed).choice(len(x), min(asked, len(x)), replace=False)
        q = x[drawn]
        inner = q @ x.T
        inner[np.arange(len(q)), drawn] = -np.inf
        near = np.argpartition(-inner, k - 1, axis=1)[:, :k]
        rows, place = np.unique(near, return_inverse=True)
        homes = np.concatenate([self.assign(lift(x[rows[at : at + 1024]], self.longest), slack, copies) for at in range(0, len(rows), 1024)])
        q, place = aim(q, self.longest), place.reshape(near.shape)
        far = _distances(q, self.centres)
        far /= np.maximum(far.min(1, keepdims=True), 1e-9 * self.longest)
        need = [np.where(homes[p], far[i], np.inf).min(1) for i, p in enumerate(place)]
        ratio = float(np.quantile(need, recall, method="higher"))
        while ratio < 1e9:  # the walk may miss lists that the distances allow
            read = self.search(q, ratio)
            if read.all() or np.mean([(homes[p] & r).any(1) for p, r in zip(place, read)]) >= recall:
                return ratio
            ratio *= 1.05
        return 1e9  # every list


def aim(q: np.ndarray, longest: float) -> np.ndarray:
    """Queries at norm ``longest``, with nothing in the component that ``lift`` adds."""
    q = tamed(q)
    size = np.linalg.norm(q, axis=1, keepdims=True)
    return np.concatenate([q / np.where(size > 0, size, 1) * longest, np.zeros((len(q), 1))], axis=1)


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all rows have norm ``longest``: nearest then means largest inner product."""
    return np.concatenate([x, np.sqrt(np.maximum(0, longest**2 - (x**2).sum(1)))[:, None]], axis=1)


def search_inner(
    embeddings: DataFrame, is_query, scratch: Scratch, k: int = 20, per_list: int = 64, most_lists: int = 4096, fit: int = 16_384,
    slack: float = 0.1, copies: int = 4, ratio: float = 1.2, recall: float = 0.95, unit: int = 512, entries: int = 20_000, askers: int = 1024, seed: int = 9,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row, the ``k`` rows of largest inner product found.

    Queries are the rows of ``embeddings`` (vec_id, embedding) where ``is_query`` holds; candidates
    are all rows but the query's own, ties go to the smaller vec_id, and scores are inner products of
    the original vectors in doubles. Centres are fitted on a hashed sample of about ``fit`` distinct
    vectors at most; every vector is indexed, boundary ones in up to ``copies`` lists. Equal vectors
    are one entry that carries its k + 1 smallest ids, which is all a query can return of it.
    Vectors that are null, zero or hold null or non-finite components take no part.
    A query reads all lists whose centre is within ``ratio`` times the distance of its nearest one,
    and all lists, if those hold fewer than k + 1 vectors. Where that ratio would miss more than
    1 - ``recall`` of the neighbours inside the sample, the least one that does not takes its place.
    """
    spark = embeddings.sparkSession
    rows = scratch.put(usable(embeddings), "vectors")
    kinds = classes(rows, scratch, k + 1)
    drawn, total = sample(kinds, fit, seed), kinds.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(drawn):
        return spark.createDataFrame([], schema)

    @F.pandas_udf("double")
    def largest(v: pd.Series) -> pd.Series:
        return pd.Series(np.abs(_matrix(v.tolist())).max(axis=1)) if len(v) else pd.Series([], dtype="float64")

    @F.pandas_udf("double")
    def norm(v: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(np.ldexp(_matrix(v.tolist()), -power), axis=1)) if len(v) else pd.Series([], dtype="float64")

    # distances are taken at a common scale, a power of two that only very long or short vectors need
    most = kinds.agg(F.max(largest("v"))).first()[0]
    power = int(np.frexp(most)[1]) if not 1e-100 < most < 1e100 else 0
    longest, drawn = kinds.agg(F.max(norm("v"))).first()[0], np.ldexp(drawn, -power)
    fitted = Lists.fit(drawn, longest, total, per_list, most_lists, 24, seed)
    ratio = max(ratio, fitted.reach(drawn, k, recall, slack, copies, seed=seed))
    index = spark.sparkContext.broadcast((fitted.centres, fitted.graph, fitted.longest))

    def file(batches):
        model = Lists(*index.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, lists = np.nonzero(model.assign(lift(np.ldexp(_matrix(part.column(1).to_pylist()), -power), model.longest), slack, copies))
                kept = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *kept.columns], names=["list", "cid", "v", "least"])

    least = F.coalesce(F.get("ids", F.lit(0)), F.lit((1 << 63) - 1)).alias("least")  # breaks ties before every cut
    posted = scratch.put(kinds.select("cid", "v", least).mapInArrow(file, "list int, cid long, v binary, least long"), "posted")
    n_lists = len(fitted.centres)
    size = np.zeros(n_lists, np.int64)
    for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect():  # one row for each list
        size[r.list] = r.n
    units = np.maximum(1, -(-size // unit))  # a long list is read in units of about ``unit`` entries
    first = np.cumsum(units) - units
    groups = max(1, math.ceil(size.sum() / entries))
    group_of = np.random.default_rng(seed).permutation(int(units.sum())) % groups

    asked = rows.where(is_query).select("vec_id", "v")

    @F.pandas_udf("int")
    def unit_of(lists: pd.Series, cid: pd.Series) -> pd.Series:
        mixed = (cid.to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        at = lists.to_numpy()
        return pd.Series((first[at] + mixed.astype(np.int64) % units[at]).astype(np.int32))

    @F.pandas_udf("int")
    def to_group(unit: pd.Series) -> pd.Series:
        return pd.Series(group_of[unit.to_numpy()].astype(np.int32))

    def ask(batches):
        model = Lists(*index.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = _matrix(part.column(1).to_pylist())
                found = model.search(aim(q, model.longest), ratio)
                found[(found * size).sum(1) <= 2 * k * copies] = True
                out: list[tuple] = []
                for i, (qid, v) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    mine = np.concatenate([np.arange(first[c], first[c] + units[c]) for c in np.flatnonzero(found[i] & (size > 0))])
                    own = group_of[mine]
                    out += [(int(g), qid, v, mine[own == g].astype(np.int32).tobytes()) for g in np.unique(own)]
                cols = list(zip(*out)) if out else [[]] * 4
                kinds_ = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_)], names=["g", "id", "v", "units"])

    asking = asked.mapInArrow(ask, "g int, id long, v binary, units binary").select(
        "g", F.lit(True).alias("asks"), "id", "v", "units", F.lit(None).cast("int").alias("unit"), F.lit(0).cast("long").alias("least"))
    held = posted.withColumn("unit", unit_of("list", "cid")).withColumn("g", to_group("unit")).select(
        "g", F.lit(False).alias("asks"), F.col("cid").alias("id"), "v", F.lit(None).cast("binary").alias("units"), "unit", "least")

    def read(q, qid, asks, yv, yid, yu, yl):
        """The best k + 1 entries of each asker, unit by unit: only entries that reach its last place so far are sorted in."""
        pair_q, pair_u = np.repeat(np.arange(len(q)), [len(a) for a in asks]), np.concatenate(asks)
        by_unit = np.argsort(pair_u, kind="stable")
        pair_q, pair_u, keep = pair_q[by_unit], pair_u[by_unit], k + 1
        top = np.full((len(q), keep), -np.inf)
        who = np.full((len(q), keep), -1, np.int64)
        low = np.full((len(q), keep), np.iinfo(np.int64).max)
        for u in np.unique(yu):
            from_, to = np.searchsorted(pair_u, [u, u + 1])
            lo, hi = np.searchsorted(yu, [u, u + 1])
            ask_ = pair_q[from_:to]
            if not len(ask_):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                s = q[ask_] @ yv[lo:hi].T
            s = np.where(np.isnan(s), -np.inf, s)  # products of both signs beyond the doubles
            least = top[ask_, -1]
            if hi - lo > keep:
                least = np.maximum(least, np.partition(s, hi - lo - keep, axis=1)[:, hi - lo - keep])
            i, j = np.nonzero(s >= least[:, None])
            if not len(i):
                continue
            again = (who[ask_[i]] == yid[lo + j][:, None]).any(1)  # a boundary vector met in an earlier list counts once
            i, j = i[~again], j[~again]
            some, start, n = np.unique(i, return_index=True, return_counts=True)
            if not len(some):
                continue
            at = (np.repeat(np.arange(len(some)), n), np.arange(len(i)) - np.repeat(start, n))
            rows = ask_[some]
            wide = (len(some), int(n.max()))
            new_s, new_who, new_low = np.full(wide, -np.inf), np.full(wide, -1, np.int64), np.full(wide, np.iinfo(np.int64).max)
            new_s[at], new_who[at], new_low[at] = s[i, j], yid[lo + j], yl[lo + j]
            s, cand, ids = (np.concatenate(x, axis=1) for x in ((top[rows], new_s), (who[rows], new_who), (low[rows], new_low)))
            order = np.lexsort((cand < 0, ids, -s), axis=1)[:, :keep]
            top[rows], who[rows], low[rows] = (np.take_along_axis(m, order, 1) for m in (s, cand, ids))
        i, j = np.nonzero(who >= 0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (qid[i], who[i, j], low[i, j], top[i, j])], names=["query_id", "cid", "least", "score"])

    def run(batches):
        """A group's entries come first and are held; its askers then pass by, some at a time."""
        now, parts, entry = None, [], None
        for batch in batches:
            g, asks = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), bool)
            edges = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(g)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if g[lo] != now:
                    now, parts, entry = g[lo], [], None
                if not asks[lo]:
                    parts.append(batch.slice(lo, hi - lo))
                    continue
                if entry is None and parts:
                    rows = pa.Table.from_batches(parts).sort_by([("unit", "ascending"), ("id", "ascending")])
                    entry = (_matrix(rows.column("v").to_pylist()), *(rows.column(c).to_numpy() for c in ("id", "unit", "least")))
                    parts = []
                for at in range(lo, hi if entry else lo, askers):
                    some = batch.slice(at, min(askers, hi - at))
                    yield read(_matrix(some.column("v").to_pylist()), some.column("id").to_numpy(), [np.frombuffer(u, np.int32) for u in some.column("units").to_pylist()], *entry)

    dealt = asking.unionByName(held).repartition("g").sortWithinPartitions("g", "asks")
    found = dealt.mapInArrow(run, "query_id long, cid long, least long, score double")
    best = found.groupBy("query_id", "cid").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "least", "cid")
    short = best.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= 2 * k)
    named = short.join(kinds.select("cid", "ids"), "cid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
