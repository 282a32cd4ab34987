"""How far the sources of a language differ in their terms: quadtrees over the matrix of groups and terms."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch, by_value, lookup

by_value(__name__)

UNIT = 10**9  #: prices are in billionths
LEAF = 8  #: side of a leaf of the quadtree
# ASCII letters become lower case, other ASCII becomes space; bytes of all other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(data: bytes, size: int = 1 << 22):
    """``data`` in parts of about ``size`` that end at spaces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def term_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents, summed in each task until it holds ``most`` terms.

    A term may have several rows; the empty term, with zeros, stands for a group as such. Null texts,
    languages and sources count as empty.
    """
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def rows(held):
        for (lang, source), (n, df) in held.items():
            n[b""] = df[b""] = 0
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array([t.decode() for t in part]),
                     pa.array([n[t] for t in part], pa.int64()), pa.array([df[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "df"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    n, df = held.setdefault((lang, source), (Counter(), Counter()))
                    before, seen = len(n), set()
                    for piece in pieces(text.encode().translate(FOLD)):
                        words = piece.split()
                        n.update(words)
                        seen.update(words)
                    df.update(seen)
                    size += len(n) - before
                    if size > most:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    return text.mapInArrow(run, "lang string, source string, term string, n long, df long")


def price(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), in decimals, so that nothing overflows."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(n + 2) * F.lit(UNIT).cast("decimal(11,0)"), wide(total + 2 * kept)) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)) of two prices; the square stays below 2 ** 63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Quadtree:
    """K-squared tree (K = 2) of one matrix of prices: levels of quadrants that hold a cell, and leaves of LEAF x LEAF cells.

    A level lists its non-empty quadrants by sorted code, row times width plus column; an absent one is
    all zeros. Level 0 is that of the leaves, whose cells are dense, 0 being no cell.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, cols: int):
        r, c, tall, wide = row // LEAF, col // LEAF, -(-rows // LEAF), -(-cols // LEAF)
        codes, at = np.unique(r * wide + c, return_inverse=True)
        self.cells = np.zeros((len(codes), LEAF, LEAF), np.int64)
        self.cells[at, row % LEAF, col % LEAF] = value
        self.levels = [(wide, codes)]
        while tall > 1 or wide > 1:
            r, c = codes // wide, codes % wide
            tall, wide = -(-tall // 2), -(-wide // 2)
            codes = np.unique((r // 2) * wide + c // 2)
            self.levels.append((wide, codes))

    def find(self, level: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Place of each quadrant in its level's list, -1 where it is all zeros."""
        wide, codes = self.levels[level]
        code = r * wide + c
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where((codes[at] == code) & (c < wide), at, -1)

    def shared_leaves(self, step: int = 1 << 16):
        """(r1, r2, c), r1 <= r2: leaf rows that both have cells in leaf column c, by joint descent from the root."""
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero, zero)]
        while stack:
            level, r1, r2, c = stack.pop()
            if level == 0:
                yield r1, r2, c
                continue
            found = []
            for a in (0, 1):
                for b in (0, 1):
                    for e in (0, 1):
                        x, y, z = 2 * r1 + a, 2 * r2 + b, 2 * c + e
                        both = (x <= y) & (self.find(level - 1, x, z) >= 0) & (self.find(level - 1, y, z) >= 0)
                        found.append((x[both], y[both], z[both]))
            r1, r2, c = (np.concatenate(v) for v in zip(*found))
            for at in range(0, len(c), step):
                stack.append((level - 1, r1[at : at + step], r2[at : at + step], c[at : at + step]))


def tile_sums(row: np.ndarray, col: np.ndarray, p: np.ndarray, z: np.ndarray, cols: int) -> np.ndarray:
    """For each pair (i < j) of rows: its gaps over the tile's columns, less those of its two zero prices.

    ``p`` are the prices of the cells (row, col), ``z`` the price of each row's zeros. Columns in which both
    rows are zero add nothing to this difference, so quadrants of zeros are never looked at. Where one has a
    cell, its price meets the other's zero price, by distinct price; where both have, leaves are met in pairs.
    """
    n = len(z)
    zero = apart(z[:, None], z[None, :])
    cells = np.bincount(row, minlength=n)
    out = -(cells[:, None] + cells[None, :]) * zero
    order = np.lexsort((p, row))
    r, v = row[order], p[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])]
    starts = np.flatnonzero(new)
    r, v, times = r[starts], v[starts], np.diff(np.r_[starts, len(row)])
    one = np.zeros((n, n), np.int64)
    step = max(1, (1 << 21) // n)
    for at in range(0, len(r), step):
        part = slice(at, at + step)
        np.add.at(one, r[part], apart(v[part, None], z[None, :]) * times[part, None])
    out += one + one.T
    by_use = np.argsort(np.argsort(-np.bincount(col, minlength=cols), kind="stable"))  # columns of few cells end together
    tree = Quadtree(row, by_use[col], p, n, cols)
    tall = -(-n // LEAF) * LEAF
    price_of, both = np.ones(tall, np.int64), np.zeros((tall, tall), np.int64)
    price_of[:n] = z
    inside = np.arange(LEAF)
    for r1, r2, c in tree.shared_leaves():
        for at in range(0, len(c), 512):
            a, b, k = r1[at : at + 512], r2[at : at + 512], c[at : at + 512]
            x, y = tree.cells[tree.find(0, a, k)][:, :, None, :], tree.cells[tree.find(0, b, k)][:, None, :, :]
            zx = price_of[a[:, None] * LEAF + inside][:, :, None, None]
            zy = price_of[b[:, None] * LEAF + inside][:, None, :, None]
            full = (x > 0) & (y > 0)
            x, y = np.maximum(x, 1), np.maximum(y, 1)
            more = np.where(full, apart(x, y) - apart(x, zy) - apart(zx, y) + apart(zx, zy), 0).sum(-1)
            np.add.at(both, (a[:, None, None] * LEAF + inside[None, :, None], b[:, None, None] * LEAF + inside[None, None, :]), more)
    return out + both[:n, :n]


def _tile(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of one tile: block of terms, and two blocks of groups, the same or one before the other."""
    groups = groups.sort_by("idx")
    idx, z, side = (groups.column(c).to_numpy().astype(np.int64) for c in ("idx", "z", "side"))
    lang, kept, block, lo, hi = (groups.column(c)[0].as_py() for c in ("lang", "kept", "block", "lo", "hi"))
    names, zero = groups.column("source").to_pylist(), apart(z[:, None], z[None, :])
    out = kept * zero if block == 0 else np.zeros_like(zero)
    if cells.num_rows:
        term = cells.column("term").combine_chunks().dictionary_encode()
        term = term.chunk(0) if isinstance(term, pa.ChunkedArray) else term
        row = np.searchsorted(idx, cells.column("idx").to_numpy())
        out = out + tile_sums(row, term.indices.to_numpy().astype(np.int64), cells.column("p").to_numpy(), z, len(term.dictionary))
    asked = np.triu(np.ones_like(zero, bool), 1)
    if lo != hi:
        asked &= (side[:, None] == lo) & (side[None, :] == hi)
    i, j = np.nonzero(asked)
    return pa.table({
        "lang": pa.array([lang] * len(i), pa.string()), "a": pa.array([names[k] for k in i], pa.string()),
        "b": pa.array([names[k] for k in j], pa.string()), "value": pa.array(out[i, j], pa.int64())})


def audit(docs: DataFrame, scratch: Scratch, least_docs: int = 10, top: int = 10, rows: int = 512, cells: int = 1 << 16) -> DataFrame:
    """(lang, source, part, item, value, rank): gaps between the sources of a language, and each source's own terms.

    Terms are runs of letters and non-ASCII characters, A-Z in lower case; a language keeps those of
    ``least_docs`` of its documents. Part ``pair`` has each other source of the language, by the gap of
    their prices summed over the kept terms; part ``term`` the ``top`` kept terms that a source uses above
    the language's price. Ties go to the smaller item. A group whose texts have no terms takes part with zero
    counts; a language of one source has no pairs. Null counts as empty; empty tables give none; repeated
    rows count each; only lang, source and text are read.

    Terms are dealt by hash into tiles of about ``cells`` cells, groups into blocks of ``rows``; a task
    holds one tile and two blocks.
    """
    counts = scratch.put(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    real = counts.where("term <> ''")
    kept = real.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least_docs).drop("df")
    kept = scratch.put(kept, "kept")
    found = scratch.put(real.drop("df").join(kept.hint("shuffle_merge"), ["lang", "term"]), "cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_cells"))
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    by_lang = Window.partitionBy("lang")  # one row per source
    groups = groups.na.fill(0, ["total", "n_cells", "kept", "lang_total"]).withColumns({
        "idx": F.row_number().over(by_lang.orderBy("source")) - 1,
        "blocks": F.greatest(F.ceil(F.sum("n_cells").over(by_lang) / cells), F.lit(1)).cast("int"),
        "sides": F.ceil(F.count("*").over(by_lang) / rows).cast("int"),
        "z": F.when(F.col("kept") > 0, price(F.lit(0), F.col("total"), F.col("kept"))).otherwise(1)})
    groups = scratch.put(groups, "groups")
    heavy = F.col("n_cells") > found.count() / 1000
    priced = lookup(found, groups.drop("z"), ["lang", "source"], heavy).withColumns({
        "p": price(F.col("n"), F.col("total"), F.col("kept")), "q": price(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})
    priced = scratch.put(priced.select("lang", "source", "idx", "term", "p", "q", "blocks", "sides"), "priced")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    def dealt(df, block):  # every row meets each block of groups once
        df = df.withColumn("side", F.floor(F.col("idx") / rows).cast("int")).withColumn("block", block)
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        return df.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("other", "sides", "blocks")

    key = ["lang", "block", "lo", "hi"]
    left = dealt(priced.select("lang", "idx", "term", "p", "blocks", "sides"), F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    right = dealt(groups.select("lang", "source", "idx", "z", "kept", "blocks", "sides"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile, "lang string, a string, b string, value long")
    both = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"))
    pairs = both.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
