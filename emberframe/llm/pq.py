"""Near-duplicate vectors by product quantisation over coarse inverted lists."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, by_value, connected_components
from emberframe.llm.vectors import classes, k_means, nearest, sample, usable

by_value(__name__)


@dataclass
class Index:
    """Coarse centres and one codebook of residuals for each subspace, over unit vectors."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]

    @classmethod
    def fit(cls, x: np.ndarray, per_list: int, total: int, most_lists: int, sub: int, codes: int, seed: int) -> Index:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        lists = max(1, min(most_lists, total // per_list, len(x) // 8))
        centres = k_means(x, lists, 6, seed)
        rest = x - centres[nearest(x, centres)]
        cuts = [slice(i, min(i + sub, x.shape[1])) for i in range(0, x.shape[1], sub)]
        return cls(centres, [k_means(rest[:, c], codes, 5, seed) for c in cuts], cuts)

    def plain(self) -> tuple:
        """What a broadcast carries: executors need no class of this repository to read it."""
        return self.centres, self.books, self.cuts

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what the codes miss) of residuals."""
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books)], axis=1)
        missed = rest - np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(missed, axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Which lists may hold a vector within ``radius`` of each row: the nearer side of every bisector.

        A vector of list c is nearer to c than to the row's own centre, so the row is at most
        ``radius`` away from the plane between the two.
        """
        to = (x**2).sum(1)[:, None] + (self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T
        apart = np.sqrt(np.maximum(0, ((self.centres[own] ** 2).sum(1))[:, None] + (self.centres**2).sum(1)[None, :] - 2 * self.centres[own] @ self.centres.T))
        return to - to[np.arange(len(x)), own][:, None] <= 2 * radius * apart + 1e-9


def unit(blobs) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def place(rows: DataFrame, index) -> DataFrame:
    """``rows`` (cid, n, v) with ``list``, the list of its nearest centre."""

    def run(batches):
        for batch in batches:
            own = nearest(unit(batch.column(2).to_pylist()), index.value[0]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["cid", "n", "v", "list"])

    return rows.select("cid", "n", "v").mapInArrow(run, "cid long, n long, v binary, list int")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index joined to each of ``n`` nodes by links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


class Group:
    """The coded vectors of some lists, the links that askers find to them, and what those links join."""

    def __init__(self, model: Index, cid, n, v, lists, cosine: float, radius: float):
        order = np.argsort(lists, kind="stable")
        self.model, self.cosine = model, cosine
        self.cid, self.n, self.list, self.y = cid[order], n[order], lists[order], unit(v)[order]
        self.codes, missed = model.encode(self.y - model.centres[self.list])
        coded = model.centres[self.list] + np.concatenate([b[self.codes[:, m]] for m, b in enumerate(model.books)], axis=1)
        # |q - coded| <= radius + missed, as a bound on q * coded; a little lower, as tables are in single precision
        self.bound = ((1 + (coded**2).sum(1) - (radius + missed + 1e-9) ** 2) / 2 - 1e-4).astype(np.float32)
        self.links, self.root = np.zeros(len(cid), np.int64), np.arange(len(cid))

    def ask(self, cid, n, q, own, wanted):
        """(asker, its links, a vector it links to) of askers ``q``; ``wanted`` holds the lists of each."""
        model = self.model
        asks = np.zeros((len(q), len(model.centres)), bool)
        for i, w in enumerate(wanted):
            asks[i, w] = True
        # a row for each entry: a looked-up row of products is one run of memory for all askers
        near = (model.centres @ q.T).astype(np.float32)[self.list]
        row = np.empty_like(near)
        for m, (cut, book) in enumerate(zip(model.cuts, model.books)):
            near += np.take((book @ q[:, cut].T).astype(np.float32), self.codes[:, m], axis=0, out=row, mode="clip")
        j, i = np.nonzero(near >= self.bound[:, None])
        keep = asks[i, self.list[j]] & ((own[i] != self.list[j]) | (cid[i] < self.cid[j]))  # within a list, each pair has two askers
        i, j = i[keep], j[keep]
        good = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 15):
            some = slice(k, k + (1 << 15))
            good[some] = np.einsum("ij,ij->i", q[i[some]], self.y[j[some]]) >= self.cosine
        i, j = i[good], j[good]
        np.add.at(self.links, j, n[i])
        found = np.bincount(i, weights=self.n[j], minlength=len(q)).astype(np.int64)
        some, first = np.unique(i, return_index=True)
        if len(i):
            head = j[first][np.searchsorted(some, i)]
            self.root = _roots(len(self.root), np.r_[head, np.arange(len(self.root))], np.r_[j, self.root])
        return cid[some], found[some], self.cid[j[first]]

    def linked(self):
        some = self.links > 0
        return self.cid[some], self.links[some], self.cid[self.root[some]]


def link_lists(placed: DataFrame, index, cosine: float, radius: float, entries: int, askers: int = 128) -> DataFrame:
    """(cid, links, root): for each vector, the rows it links to in one group, and a vector it connects to.

    Lists are packed into groups of about ``entries`` vectors, long ones in several parts. A vector
    goes once to every group that holds one of the lists it probes, with those lists' numbers,
    however many they are. A group's own vectors come first and are held; askers then pass by,
    ``askers`` at a time. Tables of each asker's products with all codes give its distance to every
    coded entry; entries within the radius plus what their own codes miss are compared exactly.
    A group folds its links into counts and a spanning set of them, and never holds all pairs.
    """
    lists = len(index.value[0])
    size = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect():  # one row for each list
        size[r.list] = r.n
    parts = np.maximum(1, -(-size * 4 // entries))
    first = np.cumsum(parts) - parts
    per_part = np.repeat(size / parts, parts)
    group = ((np.cumsum(per_part) - per_part) // entries).astype(np.int64)
    holds = np.zeros((lists, int(group[-1]) + 1), np.float32)
    holds[np.repeat(np.arange(lists), parts), group] = np.repeat(size > 0, parts)

    @F.pandas_udf("int")
    def group_of(own: pd.Series, pick: pd.Series) -> pd.Series:
        at = own.to_numpy()
        return pd.Series(group[first[at] + pick.to_numpy() % parts[at]].astype(np.int32))

    def ask(batches):
        model = Index(*index.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x, own = unit(some.column(2).to_pylist()), some.column(3).to_numpy()
                asks = model.probes(x, own, radius)
                other = np.arange(lists)[None, :]
                asks &= (other > own[:, None]) == ((other + own[:, None]) % 2 == 0)  # of two lists, one's vectors ask
                asks[np.arange(len(x)), own] = True
                row, to = np.nonzero(asks.astype(np.float32) @ holds)
                names = [np.flatnonzero(asks[i] & (holds[:, g] > 0)).astype(np.int32).tobytes() for i, g in zip(row, to)]
                kept = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.astype(np.int32)), *kept.columns, pa.array(names, pa.binary())], names=["g", "cid", "n", "v", "list", "lists"])

    pick = F.pmod(F.xxhash64("cid"), F.lit(1 << 30)).cast("int")
    listed = placed.withColumn("g", group_of("list", pick)).withColumn("lists", F.lit(None).cast("binary"))
    asking = placed.mapInArrow(ask, "g int, cid long, n long, v binary, list int, lists binary")
    both = listed.select("g", "cid", "n", "v", "list", "lists").unionByName(asking).withColumn("asks", F.col("lists").isNotNull())

    def run(batches):
        model, now, held, made = Index(*index.value), None, [], None

        def out(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cid", "links", "root"])

        def columns(batch):
            return batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_numpy()

        for batch in batches:
            g, asks = batch.column(0).to_numpy(), np.array(batch.column(6).to_pylist(), bool)
            edges = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(g)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if g[lo] != now:
                    if made is not None:
                        yield out(made.linked())
                    now, held, made = g[lo], [], None
                if not asks[lo]:
                    held.append(columns(batch.slice(lo, hi - lo)))
                    continue
                if made is None and held:
                    cid, n, v, own = zip(*held)
                    made = Group(model, np.concatenate(cid), np.concatenate(n), [x for part in v for x in part], np.concatenate(own), cosine, radius)
                    held = []
                for at in range(lo, hi if made is not None else lo, askers):
                    some = batch.slice(at, min(askers, hi - at))
                    cid, n, v, own = columns(some)
                    yield out(made.ask(cid, n, unit(v), own, [np.frombuffer(w, np.int32) for w in some.column(5).to_pylist()]))
        if made is not None:
            yield out(made.linked())

    return both.repartition("g").sortWithinPartitions("g", "asks").mapInArrow(run, "cid long, links long, root long")


def near_vectors(
    embeddings: DataFrame, scratch: Scratch, cosine: float = 0.9, per_list: int = 256, most_lists: int = 4096, fit: int = 16_384, sub: int = 8, codes: int = 128, entries: int = 4096, seed: int = 3,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id, embedding).

    Rows link at a cosine of ``cosine`` or more, computed in doubles. Coarse lists and codebooks are
    fitted on a hashed sample of about ``fit`` distinct vectors at most; every vector is indexed.
    Equal vectors are one class: they link with each other and are compared once. Norms may be any, also
    such whose square no double holds. Vectors that take
    no part (see ``usable``) keep themselves. component_id is the smallest vec_id reachable, itself
    included.

    Candidate distances are bounds, and every list is probed whose side of the bisector is within a
    link's reach, so no link is lost, whatever the vectors' effective dimension.
    """
    rows = scratch.put(usable(embeddings, directions=True), "vectors")
    kinds = classes(rows, scratch, 1)
    drawn, total = sample(kinds, fit, seed), kinds.count()
    links = None
    if len(drawn):
        index = embeddings.sparkSession.sparkContext.broadcast(Index.fit(drawn, per_list, total, most_lists, sub, codes, seed).plain())
        radius = math.sqrt(2 - 2 * cosine)
        lists = scratch.put(place(kinds, index), "lists")
        links = scratch.put(link_lists(lists, index, cosine, radius, entries), "links")
        scratch.drop("lists")
        group = connected_components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
        counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
        kinds = kinds.join(counts, "cid", "left").join(group, F.col("cid") == F.col("node"), "left")
    else:
        kinds = kinds.withColumn("links", F.lit(0)).withColumn("component", F.col("cid"))
    kinds = kinds.select(
        "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.get("ids", F.lit(0)).alias("least"),
        F.coalesce("component", "cid").alias("component"))
    kinds = scratch.put(kinds, "kinds")
    least = kinds.groupBy("component").agg(F.min("least").alias("component_id"))
    named = kinds.join(least, "component").select(F.col("v").alias("_v"), "n_links", "component_id")
    part = rows.join(named, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id")
    size = F.size("embedding")
    dims = embeddings.where(size > 0).groupBy(size.alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    e = F.col("embedding").cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce((size == (dims.d if dims else 0)) & ~F.exists(e, odd) & F.exists(e, lambda x: x != 0), F.lit(False))
    alone = embeddings.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return part.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
