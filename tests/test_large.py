"""Plans that hold at size: what is multiplied is not broadcast, and work follows distinct places, not rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberframe.operators import grid as G
from emberframe.operators import lookback as W
from emberframe.operators import metrics as E
from emberframe.operators import model as M
from emberframe.operators import polygons as Z
from emberframe.sources import io as S

DAY = dt.date(2020, 3, 1)


def broadcasts(df):
    """The parts of a plan that are broadcast, as text."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            rest = lines[i + 1 :]
            end = next((k for k, x in enumerate(rest) if depth(x) <= depth(line)), len(rest))
            out.append("\n".join(rest[:end]))
    return out


@pytest.fixture
def events(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(50).select("id", (F.col("id") % 3).cast("int").alias("ix"), (F.col("id") % 2).cast("int").alias("iy"), F.lit(DAY).alias("date")).write.parquet(path)
    return spark.read.parquet(path)


def test_chip_offsets_are_not_broadcast(spark, events, tmp_path):
    spark.range(40000).select((F.col("id") % 200).cast("int").alias("ix"), (F.col("id") / 200).cast("int").alias("iy"), F.rand(1).alias("v")).write.parquet(str(tmp_path / "cells"))
    got = G.chip(events.select("id", "ix", "iy"), spark.read.parquet(str(tmp_path / "cells")), 4)
    assert not [b for b in broadcasts(got) if "Generate" in b or "collect_list" in b]
    assert got.columns == ["cx", "cy", "id", "v"] and got.count() == sum((min(i % 3 + 2, 4)) * (i % 2 + 2) for i in range(50))


def test_lags_are_not_broadcast(spark, events, tmp_path):
    spark.range(40000).select((F.col("id") % 3).cast("int").alias("ix"), F.date_sub(F.lit(DAY), (F.col("id") / 3).cast("int")).alias("day"), F.rand(1).alias("T")).write.parquet(str(tmp_path / "series"))
    got = W.lookback(events, spark.read.parquet(str(tmp_path / "series")), ["ix"], 60).where("T is not null")
    assert not [b for b in broadcasts(got) if "Generate" in b or "collect_list" in b]
    assert got.count() == 3000


def test_lookback_keeps_repeated_days_and_types(spark):
    e = spark.createDataFrame([(1, 1, DAY), (2, None, DAY), (3, 1, None)], "id int, loc int, date date")
    s = spark.createDataFrame([(1, DAY, 1, "a"), (1, DAY, 2, "b"), (1, DAY - dt.timedelta(2), None, "c"), (1, DAY - dt.timedelta(3), 9, "d")], "loc int, day date, n int, s string")
    got = W.lookback(e, s, ["loc"], 3)
    assert dict(got.dtypes) == {"loc": "int", "day": "date", "id": "int", "date": "date", "lag": "int", "n": "int", "s": "string"}
    rows = sorted((r.id, r.lag, r.n or 0, r.s or "") for r in got.collect())
    assert rows == [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 0, ""), (1, 2, 0, "c"), *((i, k, 0, "") for i in (2, 3) for k in range(3))]


def test_a_constant_side_has_no_correlation(spark):
    rows = spark.range(0, 98, 1, 2).select(F.rand(1).alias("a"), F.lit(1.0).alias("one"))  # 1 / 49 * 49 is below 1
    assert rows.agg(E.pearson("a", "one").alias("r")).first().r is None


def test_zone_days_follow_places_and_shapes(spark):
    ring = lambda x: [[(x, 0.0), (x + 9.0, 0.0), (x + 9.0, 9.0), (x, 9.0)]]
    layer = spark.createDataFrame([(i, ring(5.0 * (i % 3))) for i in range(30)], "zone_id int, rings array<array<struct<x:double,y:double>>>")
    points = [(i, DAY + dt.timedelta(i % 7), float(i % 20), float(i % 3) + 1) for i in range(400)] + [(900, DAY, None, 1.0)]
    got = Z.zone_days(spark.createDataFrame(points, "id long, date date, x double, y double"), layer, "id", 4.0)
    inside = lambda z: [p for p in points if p[2] is not None and 5 * (z % 3) < p[2] < 5 * (z % 3) + 9]
    assert sorted(map(tuple, got.collect())) == [(z, len(inside(z)), len({p[1] for p in inside(z)}), sum(p[0] for p in inside(z))) for z in range(30)]


def test_asof_reads_no_frame_ahead_of_a_row(spark):
    day = lambda i: DAY + dt.timedelta(i)
    series = spark.createDataFrame([(1, day(0), 1.0), (1, day(4), 2.0), (1, day(9), 3.0), (7, day(1), 9.0)], "loc int, day date, v double")
    keys = spark.createDataFrame([(1, day(-3)), (1, day(2)), (1, day(3)), (1, day(9)), (1, day(30)), (2, day(0))], "loc int, day date")
    got = S.asof_nearest_day(keys, series)
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(((r.loc, (r.day - DAY).days, r.v) for r in got.collect())) == [(1, -3, 1.0), (1, 2, 1.0), (1, 3, 2.0), (1, 9, 3.0), (1, 30, 3.0), (2, 0, None)]


def test_projection_of_one_coarse_cell_is_spread(spark):
    grid = spark.range(400).select(F.col("id").alias("cell"), (F.col("id") - F.col("id") + 1).alias("loc"), (F.col("id") / 400).alias("v"))
    climate = spark.createDataFrame([(m, 1, DAY + dt.timedelta(i), float(i)) for m in (1, 2) for i in range(60)], "member int, loc long, day date, T double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = M.project(grid, climate, M.projection_dates(climate), ["loc"], ["cell"], ["T"], ["T_cumulative_mean_30d", "v"], [(0.0, [0.01, 1.0])], ["member"])
        assert got.count() == 400 * 2 * 2 and got.distinct().count() == got.count()
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_climate_folders_are_dealt_before_they_are_written(spark, tmp_path):
    rows = spark.range(0, 2400, 1, 8).select(
        F.lit("T").alias("variable"), F.col("id").alias("loc"), F.date_add(F.lit(DAY), (F.col("id") % 90).cast("int")).alias("day"), F.rand(1).alias("value"))
    S.write_climate(rows, str(tmp_path / "c"))
    folders = list((tmp_path / "c").glob("variable=T/year=2020/month=*"))
    assert len(folders) == 3 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)  # not a file of each task
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2400


def test_features_at_hand_are_not_made_again(spark):
    grid = spark.createDataFrame([(i, i % 2, i / 9) for i in range(9)], "cell long, loc int, v double")
    climate = spark.createDataFrame([(m, k, DAY + dt.timedelta(i), float(i)) for m in (1, 2) for k in (0, 1) for i in range(40)], "member int, loc int, day date, T double")
    names, dates = ["T_cumulative_mean_30d", "v"], M.projection_dates(climate)
    feats = M.member_features(climate, dates, ["loc"], ["T"], names, ["member"])
    rest = (["loc"], ["cell"], ["T"], names, [(0.0, [0.01, 1.0])], ["member"])
    given, made = M.project(grid, None, None, *rest, feats=feats), M.project(grid, climate, dates, *rest)
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, made.collect())) and given.count() == 36
