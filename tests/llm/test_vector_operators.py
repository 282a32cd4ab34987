"""Vector operators against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import ann, pq
from emberframe.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    near = np.concatenate([x[:40] + 0.1 * rng.normal(size=(40, 16)), x[:5] * 3, x[60:63].repeat(30, axis=0)])
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([x, near])]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    ids = list(range(len(vectors) + len(odd)))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, vectors + odd, [0] * len(ids)))
    return rows + [rows[0]], len(vectors)


@pytest.fixture(scope="module")
def table(spark, made):
    return spark.createDataFrame(made[0], SCHEMA).repartition(4)


def valid(rows):
    return [(i, np.array(v, np.float64)) for i, v, _ in rows if v and len(v) == 16 and all(a is not None and math.isfinite(a) for a in v) and any(v)]


def test_near_vectors_equal_brute_force(spark, made, table):
    good = valid(made[0])
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = u @ u.T >= 0.9
    low = np.array([i for i, _ in good])
    while True:
        new = np.array([low[r].min() for r in link])
        if (new == low).all():
            break
        low = new
    want = sorted((i, int(r.sum()) - 1, int(c), i == c) for (i, _), r, c in zip(good, link, low))
    want = sorted(want + [(i, 0, i, True) for i, *_ in made[0] if i not in {g for g, _ in good}])
    got = pq.near_vectors(table, Scratch(spark), per_list=20)
    assert sorted(tuple(r) for r in got.collect()) == want
    for small in ({"per_list": 2000}, {"per_list": 20, "entries": 60}, {"per_list": 200, "entries": 40}):
        assert sorted(tuple(r) for r in pq.near_vectors(table, Scratch(spark), **small).collect()) == want


def test_near_vectors_lose_no_link_at_low_rank(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(6, 4)).repeat(200, axis=0) + 0.6 * rng.normal(size=(1200, 4))) @ rng.normal(size=(4, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in pq.near_vectors(rows, Scratch(spark), per_list=20).collect()}
    assert got == dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist()))


def test_probes_reach_every_neighbour():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = pq.Index.fit(x, 10, 600, 64, 4, 16, 0)
    own = pq.nearest(x, index.centres)
    ask = index.probes(x, own, 0.5)
    i, j = np.nonzero(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.5)
    assert ask[i, own[j]].all()


def test_search_recall_and_ties(spark, made, table):
    good = valid(made[0])
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    got = ann.search_inner(table, F.col("vec_id") % 20 == 0, Scratch(spark), per_list=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hit = total = 0
    vec = dict(zip(ids.tolist(), x))
    for q in sorted({int(i) for i in ids if i % 20 == 0}):
        mine = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in mine][:20] == list(range(1, 21)) or sum(i == q for i in ids) > 1
        assert q not in [r.vec_id for r in mine]
        assert all(math.isclose(r.score, float(vec[q] @ vec[r.vec_id]), rel_tol=1e-9) for r in mine)
        order = [(-r.score, r.vec_id) for r in mine]
        assert all(a[0] <= b[0] + 1e-12 for a, b in zip(order, order[1:]))
        s = x @ vec[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit += len(set(best.tolist()) & {r.vec_id for r in mine})
        total += 20
    assert hit / total >= 0.9


def test_search_in_small_units_and_groups(spark, table):
    one = ann.search_inner(table, F.col("vec_id") % 20 == 0, Scratch(spark), per_list=20).collect()
    many = ann.search_inner(table, F.col("vec_id") % 20 == 0, Scratch(spark), per_list=20, unit=16, entries=100, askers=5).collect()
    key = lambda r: (r.query_id, r["rank"], r.vec_id, round(r.score, 9))
    assert sorted(map(key, one)) == sorted(map(key, many))


def test_reach_meets_the_recall_of_many_small_lists():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12)) * rng.uniform(0.5, 1.5, (3000, 1))
    longest = float(np.linalg.norm(x, axis=1).max())
    lists = ann.Lists.fit(x, longest, len(x), 8, 4096, 24, 5)
    homes = lists.assign(ann.lift(x, longest), 0.1, 4)
    asked = rng.choice(len(x), 200, replace=False)
    inner = x[asked] @ x.T
    inner[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-inner, axis=1)[:, :20]

    def met(ratio):
        read = lists.search(ann.aim(x[asked], longest), ratio)
        return np.mean([(homes[n] & r).any(1).mean() for n, r in zip(near, read)])

    ratio = lists.reach(x, 20, 0.95, 0.1, 4)
    assert met(1.0) < 0.5 and met(ratio) >= 0.92 and lists.reach(x[:1], 20, 0.95, 0.1, 4) == 1.0


def test_search_ties_go_to_smaller_ids(spark):
    x = np.array([[(n >> b) & 1 for b in range(9)] for n in range(1, 400)], float)
    ids = np.random.default_rng(3).permutation(len(x))
    rows = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = ann.search_inner(rows, F.col("vec_id") % 20 == 0, Scratch(spark), per_list=1000).collect()
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == ids[at])
        assert [v for _, v in mine] == ids[np.lexsort((ids, -s))[:20]].tolist()


def test_norms_beyond_the_doubles(spark):
    """Vectors whose squares under- or overflow take part and spoil nobody's links."""
    rng = np.random.default_rng(8)
    x = [rng.normal(size=2) for _ in range(60)] + [np.array([0.0, 1.0]), np.array([0.0, 2.0])]
    x += [np.array(v) for v in ([1e-200, 0.0], [1e200, 0.0], [-1e200, 1e200], [3e-310, 0.0], [1e308, 0.0], [0.0, 0.0])]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    far = [v / max(np.abs(v).max(), 5e-324) for v in x[:-1]]
    u = np.array([v / np.linalg.norm(v) for v in far])
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in pq.near_vectors(rows, Scratch(spark), per_list=10).collect()}
    assert got == {**dict(enumerate(links.tolist())), len(x) - 1: 0}
    pair = spark.createDataFrame([(1, [1e-200, 0.0]), (5, [0.0, 1.0]), (6, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.component_id for r in pq.near_vectors(pair, Scratch(spark)).collect()} == {1: 1, 5: 5, 6: 5}
    for some in (rows, pair, rows.where("vec_id % 20 = 0 OR vec_id > 61"), pair.where("vec_id = 1").union(pair.where("vec_id = 1").selectExpr("vec_id + 1", "embedding"))):
        found = ann.search_inner(some, F.lit(True), Scratch(spark), per_list=8).collect()
        vectors = {r.vec_id: np.array(r.embedding) for r in some.collect() if any(r.embedding)}
        with np.errstate(over="ignore", invalid="ignore"):
            for r in found:
                assert r.vec_id != r.query_id and math.isclose(r.score, float(vectors[r.query_id] @ vectors[r.vec_id]), rel_tol=1e-9)
        assert {r.query_id for r in found} == set(vectors) and all(sum(r.query_id == q for r in found) == min(20, len(vectors) - 1) for q in vectors)


def test_reach_ends_on_a_sample_of_one_place():
    x = np.repeat([[3.0, 4.0], [0.0, 5.0]], [40, 3], axis=0)
    lists = ann.Lists.fit(x, 5.0, len(x), 4, 64, 4, 1)
    assert 1.0 <= lists.reach(x, 20, 0.95, 0.1, 4) <= 1e9


def test_few_and_no_vectors(spark, table):
    few = table.where("size(embedding) = 16").orderBy("vec_id").limit(7)
    rows = ann.search_inner(few.withColumn("vec_id", F.col("vec_id") * 0 + F.monotonically_increasing_id() % 1000 * 20), F.col("vec_id") % 20 == 0, Scratch(spark)).collect()
    assert rows and max(r.rank for r in rows) <= 6
    assert ann.search_inner(table.limit(0), F.col("vec_id") % 20 == 0, Scratch(spark)).count() == 0
    assert pq.near_vectors(table.limit(0), Scratch(spark)).count() == 0
