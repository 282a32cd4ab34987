"""Chips by summed-area tables, long calendars, months touched, members on disk, small p-values and the fitted mode."""

import datetime as dt
import math
import random
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import levels as L
from emberframe.operators import lookback as W
from emberframe.operators import model as M
from emberframe.sources import io as S

DAY = dt.date(2020, 3, 1)


@pytest.mark.parametrize(("size", "tile"), [(32, 128), (6, 8), (4, 5), (3, 2)])
def test_chips_equal_plain_means(spark, size, tile):
    rng = random.Random(size)
    field = {(DAY + dt.timedelta(d), x, y): (rng.random() if rng.random() < 0.9 else None, float("nan") if rng.random() < 0.1 else rng.random())
             for d in range(3) for x in range(23) for y in range(11) if rng.random() < 0.7}
    grid = spark.createDataFrame([(*k, *v) for k, v in field.items()], "day date, ix int, iy int, a double, b double").repartition(3)
    events = [(i, DAY + dt.timedelta(rng.randrange(-1, 5)), rng.randrange(23), rng.randrange(11)) for i in range(40)]
    events += [(40, DAY, 0, 0), (40, DAY, 0, 0), (41, DAY, 22, 10), (42, None, 1, 1), (43, DAY, None, 1), (44, DAY, 500, 500)]
    got = W.chip_series(spark.createDataFrame(events, "id int, date date, ix int, iy int"), grid, ["a", "b"], size, 2, tile)
    assert got.columns == ["id", "date", "ix", "iy", "lag", "a", "b"]

    def mean(e, lag, k):
        if e[1] is None or e[2] is None:
            return None
        day = e[1] - dt.timedelta(lag)
        lo, hi = size // 2, size - size // 2
        v = [w[k] for (d, x, y), w in field.items() if d == day and e[2] - lo <= x < e[2] + hi and e[3] - lo <= y < e[3] + hi]
        v = [x for x in v if x is not None and not math.isnan(x)]
        return round(sum(v) / len(v), 9) if v else None

    plain = lambda r: tuple("" if v is None else str(v) for v in r)
    rows = [(*r[:5], *(None if v is None else round(v, 9) for v in r[5:])) for r in got.collect()]
    assert sorted(map(plain, rows)) == sorted(plain((*e, lag, mean(e, lag, 0), mean(e, lag, 1))) for e in events for lag in range(2))


@pytest.mark.parametrize("chunk", [1, 7, 64, 1024])
@pytest.mark.parametrize("anchor", ["newest", "oldest"])
def test_chunks_of_a_calendar_join_up(spark, chunk, anchor):
    series = spark.range(400).where("id % 7 <> 3").select(F.lit(1).alias("loc"), F.date_add(F.lit(dt.date(1969, 9, 1)), F.col("id").cast("int")).alias("day"), F.pmod(F.hash("id"), F.lit(100)).cast("double").alias("T"))
    events = spark.range(0, 430, 3).select("id", F.lit(1).alias("loc"), F.date_add(F.lit(dt.date(1969, 8, 25)), F.col("id").cast("int")).alias("date"))
    got = W.day_windows(events, series, ["loc"], ["T"], (1, 5, 30), 30, anchor, "skip", chunk)
    want = W.window_features(W.lookback(events, series, ["loc"], 30), ["id"], ["T"], (1, 5, 30), 30, anchor, "skip")
    names = sorted(c for c in want.columns)
    plain = lambda df: sorted(tuple("" if v is None else f"{v:.9g}" for v in r) for r in df.select(*names).collect())
    assert plain(got) == plain(want)


def test_only_touched_months_are_read(spark, tmp_path):
    path = str(tmp_path / "climate")
    days = spark.range(720).select(F.lit("T").alias("variable"), F.lit(1).alias("loc"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("day"), F.col("id").cast("double").alias("value"))
    S.write_climate(days.unionByName(days.withColumn("variable", F.lit("P"))), path)
    events = spark.createDataFrame([(dt.date(2020, 3, 10),), (dt.date(2021, 1, 5),), (None,)], "date date")
    assert sorted(map(tuple, S.touched_months(events, days=60).collect())) == [(2020, 1), (2020, 2), (2020, 3), (2020, 11), (2020, 12), (2021, 1)]
    read = S.read_climate_for(spark, path, "T", events)
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString()
    kept = read.select("day", F.input_file_name().alias("f")).collect()
    assert {(r.day.year, r.day.month) for r in kept} == {(2020, 1), (2020, 2), (2020, 3), (2020, 11), (2020, 12), (2021, 1)} and all("variable=T" in r.f for r in kept)
    read.write.format("noop").mode("overwrite").save()
    there = {(y, m): len(list((tmp_path / "climate" / "variable=T" / f"year={y}" / f"month={m}").glob("part-*"))) for y, m in ((2020, 1), (2020, 2), (2020, 3), (2020, 11), (2020, 12), (2021, 1))}
    assert files_read(spark) == sum(there.values()) < len(list((tmp_path / "climate").glob("variable=T/*/*/part-*")))
    assert S.read_climate_for(spark, path, "T", events.limit(0)).isEmpty()


def files_read(spark):
    """Files that the scans of the last query opened, as its metrics tell."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values = store.executionMetrics(last.executionId())
    out = 0
    for i in range(last.metrics().size()):
        m = last.metrics().apply(i)
        if m.name() == "number of files read":
            got = values.get(m.accumulatorId())
            out = max(out, int(str(got.get()).replace(",", ""))) if got.isDefined() else out
    return out


def test_members_are_written_once(spark, tmp_path):
    df = spark.range(60).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("scenario"), (F.col("id") % 3).alias("member"), "id")
    path = str(tmp_path / "out")
    assert len(M.write_members(df, df.select("scenario", "member"), path)) == 6
    (tmp_path / "out" / "scenario=a" / "member=1" / "_SUCCESS").unlink()
    again = M.write_members(df.withColumn("id", F.col("id") + 1000), df.select("scenario", "member"), path)
    assert [p.split("out/")[1] for p in again] == ["scenario=a/member=1"]
    odd = spark.createDataFrame([("a/b=c", 1), (None, 2)], "scenario string, v int")
    assert len(M.write_members(odd, odd.select("scenario"), str(tmp_path / "odd"))) == 2
    assert {(r.scenario, r.v) for r in spark.read.parquet(str(tmp_path / "odd")).collect()} == {("a/b=c", 1), (None, 2)}
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 60 and all((r.id >= 1000) == (r.scenario == "a" and r.member == 1) for r in rows)


def test_projection_of_members(spark):
    climate = spark.sql("SELECT m AS member, c AS loc, date_add(DATE'2020-01-01', CAST(d AS INT)) AS day, CAST(m * 100 + c + d AS DOUBLE) AS T FROM range(2) a(m), range(2) b(c), range(75) t(d)")
    grid = spark.createDataFrame([(1, 0, 1.0), (2, 1, None), (3, 9, 1.0)], "cell int, loc int, v double")
    dates = M.projection_dates(climate)
    assert [str(r.date) for r in dates.orderBy("date").collect()] == ["2020-01-15", "2020-02-15", "2020-03-15"]
    assert M.projection_dates(climate, [2]).count() == 1
    got = M.project(grid, climate, dates, ["loc"], ["cell"], ["T"], ["T_cumulative_mean_60d", "v"], [(0.0, [0.01, 1.0])], ["member"]).collect()
    assert len(got) == 2 * 2 * 3  # cells with a climate, members, dates
    for r in got:
        c = {1: 0, 2: 1}[r.cell]
        end = (r.date - dt.date(2020, 1, 1)).days
        z = 0.01 * sum(r.member * 100 + c + d for d in range(max(0, end - 59), min(end, 74) + 1)) / 60 + (1.0 if r.cell == 1 else 0.0)
        assert r.mean_probability == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def exact_p(t, nu):
    """Two-sided Student probability for an even ``nu``, by the finite sine series in 120 digits."""
    getcontext().prec = 120
    t = Decimal(t)
    sine, c2 = t / (t * t + nu).sqrt(), Decimal(nu) / (t * t + nu)
    term, total = Decimal(1), Decimal(0)
    for i in range(1, nu // 2 + 1):
        total += term
        term = term * c2 * (2 * i - 1) / (2 * i)
    return 1 - sine * total


def test_small_p_values_are_right(spark):
    asked = [(float(t), nu) for nu in (2, 4, 10, 40, 58, 400, 2000) for t in (0.0, 0.01, 0.5, 1.0, 2.0, 5.0, 14.0, 60.0, 1e6)]
    got = spark.createDataFrame(asked, "t double, nu int").select("t", "nu", L.student_two_sided(F.col("t"), F.col("nu")).alias("p")).collect()
    seen = []
    for r in got:
        want = exact_p(r.t, r.nu)
        seen.append(float(want))
        if want > Decimal("1e-300"):
            assert abs(Decimal(r.p) / want - 1) < Decimal("1e-9"), (r, want)
    assert sum(1e-60 < p < 1e-30 for p in seen) >= 2  # the small ones are among them
    odd = spark.createDataFrame([(3.0, 1), (-1e8, 1)], "t double, nu int").select("t", L.student_two_sided(F.col("t"), F.col("nu")).alias("p")).collect()
    assert all(r.p == pytest.approx(2 / math.pi * math.atan(1 / abs(r.t)), rel=1e-10) for r in odd)
    assert spark.createDataFrame([(1.0, 0)], "t double, nu int").select(L.student_two_sided(F.col("t"), F.col("nu")).alias("p")).first().p is None


def test_draws_equal_plain_newton(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n) * 3 + 1])
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 0.4 * x[:, 1])))).astype(int)
    rows = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int")
    odd = rows.limit(1).select("id", F.lit(None).cast("double").alias("a"), "b", "y")
    draws = M.fit_draws(rows.unionByName(odd).repartition(5), ["a", "b"], "y", {"a": 3.0, "b": 1.5}, 4, "id", seed=7)
    keys = np.array([r.h for r in rows.select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()])
    design, shrink = np.column_stack([np.ones(n), x]), np.diag([1 / 4, 1 / 9, 1 / 2.25])
    counts = [M.poisson_counts(keys, d, 7) for d in range(4)]
    assert 0.85 < np.mean(counts) < 1.15 and 0.8 < np.var(counts) < 1.2 and not (counts[0] == counts[1]).all()
    for (alpha, beta), w in zip(draws, counts):
        b = np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-design @ b))
            b -= np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + shrink, design.T @ (w * (p - y)) + shrink @ b)
        assert [alpha, *beta] == pytest.approx(b.tolist(), abs=1e-8)
    flat = M.fit_draws(rows.withColumn("y", F.lit(1)), ["a"], "y", {"a": 3.0}, 1, "id", bootstrap=False)[0]  # one class only: priors hold it
    assert all(map(math.isfinite, [flat[0], *flat[1]]))
    assert M.fit_draws(rows.limit(0), ["a"], "y", {"a": 3.0}, 2, "id") == [(0.0, [0.0])] * 2


def test_broken_member_is_skipped(spark, tmp_path):
    for k in range(3):
        S.write_file(spark.range(k + 1), str(tmp_path / f"tas_day_m{k}_x_r1_v1_9.parquet"))
    S.cut_file(spark, str(tmp_path / "tas_day_m1_x_r1_v1_9.parquet"), 50)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [f"tas_day_m{k}_x_r1_v1_9.parquet" for k in range(3)]
    got = S.read_ensemble(spark, str(tmp_path)).groupBy("member").count().collect()
    assert {r.member: r["count"] for r in got} == {"m0_x_r1_v1": 1, "m2_x_r1_v1": 3}
    with pytest.raises(Exception):
        S.read_ensemble(spark, str(tmp_path), skip_bad=False).count()
