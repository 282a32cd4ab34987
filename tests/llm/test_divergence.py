"""Source divergence: exact sums against the definition, with small tiles and blocks, and edge rows."""

import random
import re

import numpy as np
import pytest

from emberframe.llm.common import Scratch
from emberframe.llm.divergence import Quadtree, audit, pieces, tile_sums

SCHEMA = "doc_id long, text string, lang string, source string, idx int, term string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 7, "z") for i, (lang, source, t) in enumerate(rows)], SCHEMA)


def brute(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((t or "").translate(LOWER))) for lang, source, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = {}
        for _, _, terms in mine:
            for t in set(terms):
                df[t] = df.get(t, 0) + 1
        kept = sorted((t for t in df if df[t] >= least), key=lambda t: t.encode())
        sources = sorted({d[1] for d in mine}, key=lambda s: s.encode())
        n = {s: {t: sum(d[2].count(t) for d in mine if d[1] == s) for t in kept} for s in sources}
        p = {s: {t: 1 + 10**9 * (n[s][t] + 2) // (sum(n[s].values()) + 2 * len(kept)) for t in kept} for s in sources}
        every = {t: sum(n[s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (every[t] + 2) // (sum(every.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:last]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "rows", "cells"), [(1, 512, 1 << 16), (2, 4, 40), (3, 3, 1)])
def test_equals_definition(spark, seed, rows, cells):
    rng = random.Random(seed)
    vocabulary = ["été", "Été", "a", "b1c", "don't", "ZÜRICH", "日本", "x_y"] + ["w" + "abcdefghij"[k % 10] * (k // 10 + 1) for k in range(60)]
    sources = [None, "", "s0"] + [f"s{k}" for k in range(9)] + ["é"]
    data = []
    for _ in range(500):
        s = "s0" if rng.random() < 0.4 else rng.choice(sources)
        many = rng.choice([0, 3, 30])
        data.append((rng.choice(["en", "en", "fr", None]), s, " ".join(rng.choice(vocabulary[: 8 + 5 * (sources.index(s) % 12)]) for _ in range(many))))
    data += [("only", "one", "word"), ("empty", "a", None), ("empty", "b", "12 34"), ("en", "s1", "big " * 30_000), data[0], data[0]]
    got = audit(frame(spark, data), Scratch(spark), least_docs=5, top=4, rows=rows, cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(data, 5, 4)


def test_no_rows(spark):
    assert audit(spark.createDataFrame([], SCHEMA), Scratch(spark)).collect() == []


def test_quadtree_and_wide_counts():
    rng = np.random.default_rng(4)
    n, cols = 37, 90
    grid = np.where(rng.random((n, cols)) < 0.1, rng.integers(1, 10**9, (n, cols)), 0)
    grid[:, 5] = 10**9
    row, col = np.nonzero(grid)
    z = rng.integers(1, 1000, n)
    tree = Quadtree(row, col, grid[row, col], n, cols)
    met = {(a, b, c) for r1, r2, k in tree.shared_leaves(step=7) for a, b, c in zip(r1.tolist(), r2.tolist(), k.tolist())}
    full = {(a // 8, b // 8, c // 8) for a, c in zip(row.tolist(), col.tolist()) for b in np.flatnonzero(grid[:, c]).tolist() if a // 8 <= b // 8}
    assert met >= full and sum(len(r) for r, _, _ in tree.shared_leaves()) == len(met)
    price = np.where(grid > 0, grid, z[:, None])
    got = tile_sums(row, col, grid[row, col], z, cols)
    for i in range(n):
        for j in range(i + 1, n):
            f = lambda p, q: (p - q) ** 2 // (p + q)
            assert got[i, j] == f(price[i], price[j]).sum() - cols * f(z[i], z[j])


def test_pieces():
    data = b"ab  cd " * 5 + b"x" * 30
    assert b"".join(pieces(data, 4)) == data and [w for p in pieces(data, 4) for w in p.split()] == data.split()


def test_prices_of_large_counts(spark):
    from pyspark.sql import functions as F

    from emberframe.llm.divergence import price

    n, total, kept = 9 * 10**15, 9 * 10**17, 10**8
    got = spark.range(1).select(price(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
