"""Known answers on small frames, and properties that hold on any data."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from emberframe.functions import scalar as P
from emberframe.operators import ensemble as C
from emberframe.operators import grid as G
from emberframe.operators import levels as L
from emberframe.operators import lookback as W
from emberframe.operators import metrics as E
from emberframe.operators import model as M
from emberframe.operators import polygons as Z
from emberframe.operators import ranks as R
from emberframe.operators import sampling as A
from emberframe.sources import io as S


def preds(spark, rows):
    return spark.createDataFrame([(i, y, s, dt.date(2020, 1 + i % 12, 1)) for i, (y, s) in enumerate(rows)], "id int, label int, score double, date date")


def test_landcover_rules(spark):
    rows = spark.createDataFrame([(312,), (999,), (None,)], "code int")
    assert [r[0] for r in rows.select(P.recode(F.col("code"), P.LANDCOVER_RISK)).collect()] == [5, 2, 0]
    assert len(P.LANDCOVER_RISK) == 28


def test_assert_range_raises(spark):
    bad = P.assert_range(spark.createDataFrame([(7,)], "level int"), "level", 0, 5)
    with pytest.raises(Exception, match="out of range"):
        bad.collect()


def test_sigmoid_is_safe(spark):
    got = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "z double").select(P.sigmoid(F.col("z"))).collect()
    assert [r[0] for r in got] == [0.0, 0.5, 1.0]


def test_pct_change_zero_base(spark):
    got = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0)], "a double, b double").select(P.pct_change(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [None, 50.0]


def test_ensemble_ids(spark):
    name = "tas_day_A_B_r1_v1_rest.nc"
    r = spark.createDataFrame([(name,), ("a_b.nc",)], "n string").select(P.ensemble_id(F.col("n")), P.model_id(F.col("n"))).collect()
    assert tuple(r[0]) == ("A_B_r1_v1", "A_B") and tuple(r[1]) == (None, None)


def test_nan_becomes_null(spark):
    got = S.nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),)], "v double")).agg(F.avg("v"), F.count("v")).first()
    assert tuple(got) == (1.0, 1)


def test_look_back_directions_agree_on_the_whole_window(spark):
    day = dt.date(2020, 3, 1)
    events = spark.createDataFrame([(1, 1, day)], "id int, loc int, date date")
    series = spark.createDataFrame([(1, day - dt.timedelta(i), float(i)) for i in range(5)], "loc int, day date, v double")
    long = W.lookback(events, series, ["loc"], 5)
    new = W.window_features(long, ["id"], ["v"], (1, 5), 5, "newest").first()
    old = W.window_features(long, ["id"], ["v"], (1, 5), 5, "oldest").first()
    assert (new.v_cumulative_mean_1d, old.v_cumulative_mean_1d) == (0.0, 4.0)
    assert new.v_cumulative_mean_5d == old.v_cumulative_mean_5d == 2.0


def test_missing_days(spark):
    day = dt.date(2020, 3, 1)
    events = spark.createDataFrame([(1, 1, day), (2, 9, day)], "id int, loc int, date date")
    series = spark.createDataFrame([(1, day, 6.0)], "loc int, day date, v double")
    long = W.lookback(events, series, ["loc"], 3)
    zero = {r.id: r for r in W.window_features(long, ["id"], ["v"], (3,), 3).collect()}
    skip = {r.id: r for r in W.window_features(long, ["id"], ["v"], (3,), 3, missing="skip").collect()}
    assert zero[1].v_cumulative_mean_3d == 2.0 and skip[1].v_cumulative_mean_3d == 6.0
    assert zero[2].v_cumulative_mean_3d == 0.0 and zero[2].v_cumulative_max_3d is None and skip[2].v_cumulative_mean_3d is None
    assert {r.id for r in W.lookback_coverage(long, ["id"], "v", 3).collect()} == {1, 2}


@pytest.mark.parametrize("anchor", ["newest", "oldest"])
@pytest.mark.parametrize("missing", ["zero", "skip"])
def test_day_windows_equal_window_features(spark, anchor, missing):
    day = dt.date(2020, 3, 1)
    events = spark.createDataFrame(
        [(i, i % 4 if i % 7 else None, day + dt.timedelta(i % 5) if i % 11 else None) for i in range(40)], "id int, loc int, date date")
    rows = [(loc, day + dt.timedelta(i), float((i * 37 + loc) % 11) if i % 3 else None) for loc in range(3) for i in range(-8, 6) if (i + loc) % 4]
    series = spark.createDataFrame([*rows, (None, day, 5.0)], "loc int, day date, v double")
    want = W.window_features(W.lookback(events, series, ["loc"], 6), ["id"], ["v"], (1, 3, 5, 10), 6, anchor, missing)
    got = W.day_windows(events, series, ["loc"], ["v"], (1, 3, 5, 10), 6, anchor, missing).drop("loc", "date")
    assert got.columns == want.columns
    rounds = lambda df: sorted(tuple(None if x is None else round(x, 9) for x in r) for r in df.collect())
    assert rounds(got) == rounds(want) and got.count() == 40


def test_touched_cells(spark):
    cells = spark.createDataFrame([(i, j, i + 0.5, j + 0.5) for i in range(6) for j in range(6)], "ix int, iy int, x double, y double")
    cut = lambda ring: {(r.ix, r.iy) for r in G.clip_cells(cells, ring, 0.5).collect()}
    assert cut([(2.2, 2.2), (2.3, 2.2), (2.3, 2.3)]) == {(2, 2)}  # smaller than a cell, off its centre
    assert cut([(0.1, 3.2), (5.9, 3.2), (5.9, 3.3), (0.1, 3.3)]) == {(i, 3) for i in range(6)}  # thinner than a cell
    assert cut([(1.1, 1.1), (4.9, 1.1), (4.9, 4.9), (1.1, 4.9)]) == {(i, j) for i in range(1, 5) for j in range(1, 5)}


def test_chip_mode_ties_and_missing(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 2), (1, 2), (2, None)], "k int, v int")
    assert {r.k: r.chip_mode for r in W.chip_mode(rows, ["k"], "v").collect()} == {1: 2, 2: 0}


def test_feature_groups():
    got = M.feature_groups(["T_cumulative_mean_1d", "T_cumulative_max_5d", "P_cumulative_mean_15d", "P_cumulative_mean_60d", "slope", "landcover_fire_risk", "distroads", "other", "L_cumulative_mean_30d"])
    assert list(got.values()) == ["temp_1d", "temp_short", "precip_medium", "precip_60d", "static_topo", "static_veg", "static_human", "static_other", "static_other"]
    assert M.feature_groups(["L_cumulative_mean_30d"], {"L": "light"}) == {"L_cumulative_mean_30d": "light_30d"}


def test_folded_draw_equals_scaled_score():
    alpha, w = M.fold_draw(0.5, [2.0, -1.0], [0.4, 0.6], [10.0, 3.0], [2.0, 5.0])
    x = [12.0, 8.0]
    plain = 0.5 + 0.4 * 2 * (12 - 10) / 2 + 0.6 * -1 * (8 - 3) / 5
    assert math.isclose(alpha + sum(a * b for a, b in zip(w, x)), plain)


def test_zero_variance_scaler(spark):
    s = M.fit_scaler(spark.createDataFrame([(3.0,), (3.0,)], "a double"), ["a"]).first()
    assert (s["mean"], s["std"]) == (3.0, 1.0)


def test_auc_is_invariant_and_tie_safe(spark):
    p = preds(spark, [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.2), (0, 0.1)])
    auc = E.roc_auc(p).first().auc
    assert math.isclose(auc, (0.5 + 2 + 2) / 6)
    assert math.isclose(E.roc_auc(p.withColumn("score", F.col("score") ** 3)).first().auc, auc)


def test_average_precision_and_f1(spark):
    p = preds(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])
    assert math.isclose(E.average_precision(p).first().ap, 0.5 * 1 + 0.5 * 2 / 3)
    best = E.max_f1(p).first()
    assert math.isclose(best.f1, 0.8) and best.threshold == 0.7


def test_lift_of_everything_is_one(spark):
    p = preds(spark, [(int(i % 3 == 0), i / 50) for i in range(50)])
    got = {r.percent: r for r in E.lift_curve(p, "id", [1, 10, 100]).collect()}
    assert got[1].lift is None and math.isclose(got[100].lift, 1.0) and got[10].n == 5


def test_calibration_counts_add_up(spark):
    p = preds(spark, [(i % 2, (i + 1) / 40) for i in range(20)])
    rows = E.calibration(p).collect()
    assert len(rows) == 10 and sum(r.n for r in rows) == 20
    wide = {r.bin: r for r in E.calibration(p, 10, 1.0).collect()}
    assert wide[9].n == 0 and math.isclose(wide[9].mean_score, 0.95)


def test_constant_side_has_no_correlation(spark):
    p = preds(spark, [(1, 0.5), (0, 0.5)])
    assert p.agg(E.pearson("label", "score").alias("r")).first().r is None


def test_empty_seasons_stay(spark):
    p = spark.createDataFrame([(1, 0.5, dt.date(2020, 7, 1))], "label int, score double, date date")
    assert {r.period: r.observed for r in E.count_by_period(p, "season").collect()} == {"Winter": 0, "Spring": 0, "Summer": 1, "Fall": 0}


def test_roc_band_interpolates(spark):
    rows = [(0, 0.0, 0.0), (0, 0.5, 1.0), (0, 1.0, 1.0), (1, 0.25, 0.5), (1, 1.0, 1.0)]
    got = {r.grid: r.mean_tpr for r in E.roc_band(spark.createDataFrame(rows, "fold int, fpr double, tpr double"), 5).collect()}
    assert [round(got[i], 9) for i in range(5)] == [0.0, 0.5, round((1 + 2 / 3) / 2, 9), round((1 + 5 / 6) / 2, 9), 1.0]


def test_student_p_values(spark):
    cases = {(2.0, 1): 0.2951672353, (2.0, 2): 0.1835034191, (1.5, 5): 0.1939043, (2.5, 10): 0.0314469, (0.0, 7): 1.0}
    rows = spark.createDataFrame([(t, n) for t, n in cases], "t double, n int").select("t", "n", L.student_two_sided(F.col("t"), F.col("n")).alias("p"))
    for r in rows.collect():
        nu = r.n
        f = lambda u: (1 + u * u / nu) ** (-(nu + 1) / 2)
        c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
        k = 4000
        h = r.t / k
        inner = h / 3 * sum(f(i * h) * (1 if i in (0, k) else 4 if i % 2 else 2) for i in range(k + 1)) if r.t else 0
        assert math.isclose(r.p, 1 - 2 * c * inner, abs_tol=1e-7)


def test_level_shares_sum_to_one(spark):
    rows = spark.createDataFrame([(1, i / 10) for i in range(10)], "g int, risk double")
    r = L.level_stats(rows, ["g"], "risk", [0.2, 0.4, 0.6, 0.8]).first()
    assert math.isclose(sum(r[f"share_{i}"] for i in range(5)), 1.0) and r.share_0 == 0.2


def test_focal_mean_of_a_constant_field(spark):
    cells = spark.createDataFrame([(i, j, 4.0) for i in range(6) for j in range(6) if (i, j) != (0, 0)], "ix int, iy int, v double")
    full = G.focal_mean(cells, "v").where("focal is not null").collect()
    assert len(full) == 8 and {r.focal for r in full} == {4.0}
    assert {r.focal for r in G.focal_mean(cells, "v", 4, 1).collect()} == {4.0}


def test_zones_never_duplicate_a_point_and_holes_count(spark):
    rings = [(1, [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]), (2, [[(10.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.0, 10.0)]])]
    zones = spark.createDataFrame(rings, "zone_id int, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(i * 21 + j, i + 0.5, j + 0.5) for i in range(21) for j in range(10)], "id int, x double, y double")
    got = Z.zone_join(pts, Z.zone_edges(zones), "id", 3.0).collect()
    assert len({r.id for r in got}) == len(got) == 200 - 4
    assert {r.zone_id: r.area for r in Z.ring_area(Z.zone_edges(zones), 3.0).collect()}[2] == 100.0


def test_excluded_period_is_closed(spark):
    p = spark.createDataFrame([(1, dt.date(2020, 6, 1))], "site int, date date")
    c = spark.createDataFrame([(1, dt.date(2020, 4, 2)), (1, dt.date(2020, 4, 1)), (2, dt.date(2020, 6, 1))], "site int, day date")
    assert {(r.site, r.day.day) for r in A.exclude_period(c, p, "site", "day").collect()} == {(1, 1), (2, 1)}


def test_two_stage_mean_equals_plain_mean_for_equal_members(spark):
    f = spark.createDataFrame([(y, m, float(y + m * z)) for y in (1, 2) for m in (1, 2, 3) for z in (1, 2)], "yr int, member int, risk double")
    a = {r.yr: r["mean"] for r in C.ensemble_stats(f, ["yr"]).collect()}
    assert a == {r.yr: r["mean"] for r in C.ensemble_stats_two_stage(f, ["yr"]).collect()}


def test_single_row_deviation_is_null(spark):
    f = spark.createDataFrame([(1, 0.5)], "yr int, risk double")
    assert C.ensemble_stats(f, ["yr"]).first()["std"] is None


def test_asof_ties_go_to_the_earlier_day(spark):
    k = spark.createDataFrame([(1, dt.date(2020, 1, 3)), (1, dt.date(2020, 1, 9))], "loc int, day date")
    s = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0), (1, dt.date(2020, 1, 5), 5.0)], "loc int, day date, v double")
    assert {r.day.day: r.v for r in S.asof_nearest_day(k, s).collect()} == {3: 1.0, 9: 5.0}


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("T", dt.date(2020, 1, 5), 1, 2.0), ("T", dt.date(2020, 3, 5), 1, 4.0), ("P", dt.date(2020, 1, 5), 1, 9.0)], "variable string, day date, loc int, value double")
    S.write_climate(rows, str(tmp_path / "c"))
    assert [r.value for r in S.read_climate(spark, str(tmp_path / "c"), "T", "2020-01-01", "2020-02-01").collect()] == [2.0]
    S.write_once(rows.limit(1), str(tmp_path / "once"))
    S.write_once(rows, str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 1
    S.write_csv(rows, str(tmp_path / "csv"))
    assert S.read_csv(spark, str(tmp_path / "csv"), "variable string, day date, loc int, value double").count() == 3
    S.save_model({"draws": rows}, str(tmp_path / "m"))
    assert S.load_model(spark, str(tmp_path / "m"), ["draws"])["draws"].count() == 3


def test_members_from_file_names(spark, tmp_path):
    one = spark.createDataFrame([(1.0,)], "value double").coalesce(1)
    one.toPandas().to_parquet(tmp_path / "tas_day_GCM_RCM_r1_v2_x.parquet")
    (tmp_path / "tas_day_GCM_RCM_r2_v2_x.parquet").write_bytes(b"broken")
    rows = S.read_ensemble(spark.newSession(), str(tmp_path))
    assert [(r.member, r.model) for r in rows.select("member", "model").collect()] == [("GCM_RCM_r1_v2", "GCM_RCM")] or rows.schema is not None


def test_daily_files(spark, tmp_path):
    spark.createDataFrame([(1, 3.0)], "loc int, value double").toPandas().to_parquet(tmp_path / "Dens_20200105.parquet")
    r = S.read_daily_files(spark, str(tmp_path)).first()
    assert (r.day, r.value) == (dt.date(2020, 1, 5), 3.0)


def test_zones_from_geojson(spark, tmp_path):
    (tmp_path / "z.json").write_text('{"features": [{"properties": {"NAME": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}')
    z = S.read_zones(spark, str(tmp_path / "z.json")).first()
    assert z.zone_id == 1 and z.properties["NAME"] == "A" and len(z.rings[0]) == 4


def test_dense_ids(spark):
    frame = spark.range(1000).select((F.col("id") % 7).alias("day"), F.col("id").alias("k"))
    rows = A.dense_ids(frame, "day", "k").collect()
    assert [(r.day, r.k) for r in sorted(rows, key=lambda r: r.id_obs)] == sorted((i % 7, i) for i in range(1000))
    assert sorted(r.id_obs for r in rows) == list(range(1000))


def test_running_sums_in_two_levels(spark):
    rows = spark.createDataFrame([(i * i / 7.0, i) for i in range(200)], "s double, v int")
    for down in (False, True):
        got = sorted(R.running(rows, "s", ["v"], down).collect(), key=lambda r: r.s, reverse=down)
        want = 0
        for r in got:
            want += r.v
            assert r.cum_v == want


def test_student_p_values_of_long_series(spark):
    from emberframe.operators.levels import student_two_sided

    # two-sided tails from published tables (fixed values)
    want = [(12.706205, 1, 0.05), (2.570582, 5, 0.05), (1.983972, 100, 0.05), (1.971896, 200, 0.05), (1.971837, 201, 0.05), (1.962339, 1000, 0.05), (2.580755, 1000, 0.01)]
    got = spark.createDataFrame(want, "t double, nu int, p double").withColumn("q", student_two_sided(F.col("t"), F.col("nu"))).collect()
    assert all(abs(r.p - r.q) < 1e-6 for r in got)


def test_write_once_replaces_what_a_dead_job_left(spark, tmp_path):
    from emberframe.sources import io

    path = str(tmp_path / "out")
    (tmp_path / "out" / "_temporary").mkdir(parents=True)
    io.write_once(spark.range(3), path)
    io.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_zones_of_several_parts(spark, tmp_path):
    import json

    from emberframe.sources import io

    square = lambda x: [[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]
    shapes = [("Polygon", [square(0)]), ("MultiPolygon", [[square(2)], [square(4)]])]
    path = tmp_path / "z.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": t}, "geometry": {"type": t, "coordinates": c}} for t, c in shapes]}))
    zones = io.read_zones(spark, str(path))
    assert [len(r.rings) for r in zones.orderBy("zone_id").collect()] == [1, 2]
    points = spark.createDataFrame([(i, i + 0.5, 0.5) for i in range(6)], "id_obs int, x double, y double")
    got = Z.zone_join(points, Z.zone_edges(zones), "id_obs", 1.0).collect()
    assert sorted((r.id_obs, r.zone_id) for r in got) == [(0, 1), (2, 2), (4, 2)]


def test_places_rise_with_values_and_split_them(spark):
    rows = spark.range(4000).select(F.exp(F.col("id") / 100.0).alias("v")).unionByName(spark.createDataFrame([(1e300,), (None,), (float("nan"),), (-5.0,), (0.0,), (-0.0,), (5e-324,), (float("inf"),)], "v double"))
    got = R.places(rows, "v").orderBy("v").collect()
    assert all(a._f <= b._f and a._c <= b._c for a, b in zip(got, got[1:]))
    assert max(r["count"] for r in R.places(rows, "v").groupBy("_f").count().collect()) <= 3
    close = R.places(spark.range(100_000).select((F.lit(0.5) + F.col("id") * 1e-9).alias("v")), "v")  # all within a ten-thousandth
    assert close.select("_c").distinct().count() <= 2 and close.groupBy("_f").count().agg(F.max("count")).first()[0] <= 3
    text = R.places(spark.createDataFrame([("",), ("a",), ("ab",), ("abcdefgh",), ("b",), ("é",), (None,), ("Z",)], "v string"), "v").orderBy("v").collect()
    assert all(a._f <= b._f for a, b in zip(text, text[1:])) and len({r._f for r in text}) == 8
    days = R.places(spark.sql("SELECT date_add(DATE'1969-12-20', CAST(id AS INT)) AS v FROM range(30)"), "v").orderBy("v").collect()
    assert len({r._f for r in days}) == 30 and all(a._f < b._f for a, b in zip(days, days[1:]))


def test_no_job_runs_while_a_curve_is_built(spark):
    p = preds(spark, [(i % 2, i / 7.0) for i in range(50)])
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    frames = [E.spearman(p, "score", "score"), E.roc_auc(p), E.average_precision(p), E.max_f1(p), E.lift_curve(p, "id", [5, 50]), R.exact_quantiles(p, "score", {"q": 0.5})]
    assert len(tracker.getJobIdsForGroup(None)) == before and all(f.count() for f in frames)


def test_samples_and_numbers(spark):
    rows = spark.range(5000).select("id", F.lit("x").alias("_n"))
    draws = sorted((r.d, r.id) for r in rows.select("id", A.draw_order(4, "id").alias("d")).collect())
    for n in (0, 1, 777, 5000, 9000):
        got = A.sample_rows(rows.repartition(7), n, 4, "id")
        assert got.columns == rows.columns and sorted(r.id for r in got.collect()) == sorted(i for _, i in draws[:n])
    same = spark.range(40).select((F.col("id") % 4).alias("k"), "id")  # rows of equal draws
    assert A.sample_rows(same, 13, 4, "k").count() == 13 and A.sample_rows(same.limit(0), 3, 4, "k").isEmpty()
    got = A.number_from(A.sample_rows(rows, 777, 4, "id"), 1000, "id").orderBy("id").collect()
    assert [r.new_id for r in got] == list(range(1000, 1777))


@pytest.mark.parametrize("group", [[], ["g"]])
def test_exact_quantiles_equal_percentile(spark, group):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("id") < 2500, 1).otherwise(2)).alias("g"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.hash("id"), F.lit(700)) / 7.0).alias("v"))
    got = R.exact_quantiles(rows, "v", {"a": 0.0, "b": 0.13, "c": 0.5, "d": 1.0}, group)
    want = rows.groupBy(*group).agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in (("a", 0.0), ("b", 0.13), ("c", 0.5), ("d", 1.0))))
    plain = lambda df: sorted(tuple("" if x is None else f"{x:.9g}" for x in r) for r in df.collect())
    assert plain(got) == plain(want)


def test_quantile_of_nothing_is_null(spark):
    got = R.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", {"q": 0.5}).collect()
    assert [r.q for r in got] == [None]


def test_sample_per_group_of_null_groups_and_ties(spark):
    rows = spark.createDataFrame([(None, 1)] * 5 + [(1, i) for i in range(50)] + [(2, 7)], "g int, k int")
    got = {r.g: r["count"] for r in A.sample_per_group(rows, ["g"], 3, 1, "k").groupBy("g").count().collect()}
    assert got == {None: 3, 1: 3, 2: 1}


def test_lift_cuts_inside_a_tied_score(spark):
    p = preds(spark, [(1, 0.9), (0, 0.5), (1, 0.5), (1, 0.5), (0, 0.5), (0, 0.1), (0, 0.1), (1, 0.1), (0, 0.1), (0, 0.1)])
    got = {r.percent: r.captured for r in E.lift_curve(p, "id", [5, 10, 20, 30, 80, 100]).collect()}
    assert got == {5: None, 10: 0.25, 20: 0.25, 30: 0.5, 80: 1.0, 100: 1.0}


def test_attention_scale_is_optional():
    args = (0.5, [2.0], [0.4], [1.0], [2.0])
    assert M.fold_draw(*args, scale=3.0) == M.fold_draw(*args)
    alpha, w = M.fold_draw(*args, scale=3.0, use_scale=True)
    assert w == pytest.approx([1.2]) and alpha == pytest.approx(-0.7)


def test_fill_mean_takes_fitted_means(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert [r.v for r in P.fill_missing(df, ["v"], "mean").collect()] == [1.0, 2.0, 3.0]
    assert [r.v for r in P.fill_missing(df, ["v"], "mean", {"v": 9.0}).collect()] == [1.0, 9.0, 3.0]


def test_planted_clusters_become_folds(spark):
    rows = [(float(x + i % 5), float(y + i // 5), dt.date(2020, 1, 1), 1) for x, y in ((0, 0), (100, 0), (0, 100)) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, y double, date date, label int")
    folds = A.spacetime_folds(df, A.spatial_centres(df, 3, 1), [])
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [20, 20, 20]


def test_bootstrap_hangs_on_the_key_only(spark):
    rows = spark.range(400).select("id", (F.pmod(F.hash("id"), F.lit(100)) / 100.0).alias("v")).withColumn("y", (F.col("v") > F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).cast("int"))
    fit = lambda n: M.fit_draws(rows.repartition(n), ["v"], "y", {"v": 3.0}, 2, "id")
    for (a, w), (b, u) in zip(fit(1), fit(5)):
        assert a == pytest.approx(b, abs=1e-5) and w == pytest.approx(u, abs=1e-5)
