"""Look-back windows: frames that slide over a place's days, or exploded lags where every day is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (1, 3, 5, 10, 15, 30, 60)


def lookback(events: DataFrame, series: DataFrame, on: list[str], days: int = 60, chunk: int = 1024) -> DataFrame:
    """(events columns, lag, series columns): lag 0 is the event's day; missing days stay as NULL rows.

    The days of a window are gathered once for each place and day that is asked for, by a frame that slides over
    the series of these places, in chunks of a calendar as in ``day_windows``. Events meet them as one row and
    unfold them last, so no row is multiplied by lags before a join. Spark takes a row of many lags for one of
    a single lag, so the join is told not to broadcast.
    """
    day, values = F.col("date").alias("day"), [c for c in series.columns if c not in (*on, "day")]
    asked = events.select(*on, day).dropna().distinct()
    known = series.dropna(subset=[*on, "day"]).join(asked.select(*on).distinct(), on, "left_semi")
    known = known.select(*on, "day", F.struct("day", *values).alias("_at"))
    own = lambda back: F.floor((F.unix_date("day") + back) / chunk)
    both = asked.withColumn("_at", F.lit(None).cast(known.schema["_at"].dataType)).withColumn("_chunk", own(0)).unionByName(
        known.withColumn("_chunk", F.explode(F.sequence(own(0), own(days - 1)))))
    span = Window.partitionBy(*on, "_chunk").orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    near = both.withColumn("_near", F.collect_list("_at").over(span)).where("_at is null")
    row = lambda lag, at: F.struct(lag.cast("int").alias("lag"), *(at(v).alias(v) for v in values))
    seen = F.transform("_near", lambda s: row(F.datediff("day", s["day"]), lambda v: s[v]))
    every = F.sequence(F.lit(0), F.lit(days - 1))
    kinds = dict(series.dtypes)
    none = lambda lags: F.transform(lags, lambda i: row(i, lambda v: F.lit(None).cast(kinds[v])))
    found = near.withColumn("_seen", seen).select(
        *on, F.col("day").alias("date"), F.concat("_seen", none(F.array_except(every, F.col("_seen.lag")))).alias("_lags"))
    rest = [c for c in events.columns if c not in on]
    out = events.join(found.hint("merge"), [*on, "date"], "left").select(*on, *rest, F.inline(F.coalesce("_lags", none(every))))
    return out.select(*on, F.date_sub("date", F.col("lag")).alias("day"), *rest, "lag", *values)


def position(anchor: str, days: int) -> Column:
    """1-based place of a lag in its window: from the newest day back, or from the oldest on."""
    return F.col("lag") + 1 if anchor == "newest" else F.lit(days) - F.col("lag")


def window_features(long: DataFrame, key: list[str], variables: list[str], windows=WINDOWS, days: int = 60, anchor: str = "newest", missing: str = "zero") -> DataFrame:
    """Wide ``<V>_cumulative_<mean|max>_<w>d`` features per key, in one aggregation.

    ``missing="zero"`` divides sums by the window's days, ``"skip"`` by the days that have a value; a
    maximum ignores missing days. Windows longer than ``days`` are left out.
    """
    at, out = position(anchor, days), []
    for v in variables:
        for w in (w for w in windows if w <= days):
            inside = F.when(at <= w, F.col(v))
            mean = F.coalesce(F.sum(inside), F.lit(0.0)) / w if missing == "zero" else F.avg(inside)
            out += [mean.alias(f"{v}_cumulative_mean_{w}d"), F.max(inside).alias(f"{v}_cumulative_max_{w}d")]
    return long.groupBy(*key).agg(*out)


def day_windows(events: DataFrame, series: DataFrame, on: list[str], variables: list[str], windows=WINDOWS, days: int = 60, anchor: str = "newest", missing: str = "zero", chunk: int = 1024) -> DataFrame:
    """Rows of ``events`` (``on``, date, ...) with the features that ``window_features`` finds for their look-back.

    Windows slide over the series itself, once for each place and day that is asked for, so events
    meet one row each instead of ``days`` lags. A place's calendar is dealt in chunks of ``chunk`` days,
    each with the days before it that its windows reach, so one place may have most rows. Null places
    and dates have no series.
    """
    day, nothing = F.col("date").alias("day"), [F.lit(None).cast("double").alias(v) for v in variables]
    asked = events.select(*on, day).distinct().select(*on, "day", *nothing, F.lit(True).alias("_asked"))
    known = series.dropna(subset=[*on, "day"]).select(*on, "day", *(F.col(v).cast("double").alias(v) for v in variables), F.lit(False).alias("_asked"))
    own = lambda back: F.floor((F.unix_date("day") + back) / chunk)
    asked, known = asked.withColumn("_chunk", own(0)), known.withColumn("_chunk", F.explode(F.sequence(own(0), own(days - 1))))
    order, out = Window.partitionBy(*on, "_chunk").orderBy(F.unix_date("day")), []
    for w in (w for w in windows if w <= days):
        span = order.rangeBetween(1 - w, 0) if anchor == "newest" else order.rangeBetween(1 - days, w - days)
        for v in variables:
            mean = F.coalesce(F.sum(v).over(span), F.lit(0.0)) / w if missing == "zero" else F.avg(v).over(span)
            out += [mean.alias(f"{v}_cumulative_mean_{w}d"), F.max(v).over(span).alias(f"{v}_cumulative_max_{w}d")]
    found = asked.unionByName(known).select(*on, "day", "_asked", *out).where("_asked").drop("_asked").alias("f")
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{d}")) for c, d in zip([*on, "date"], [*on, "day"])]
    features = [c for c in found.columns if c not in (*on, "day")]
    return events.alias("e").join(found, same, "left").select("e.*", *(F.col(f"f.{c}") for c in features))


def _chip_sums(size: int, tile: int, values: list[str]):
    """For cogrouped cells and requests of one tile of a day: sums and counts of the part of each chip in the tile."""
    import numpy as np
    import pyarrow as pa

    def run(cells: pa.Table, asked: pa.Table) -> pa.Table:
        n, out = asked.num_rows, {c: asked.column(c) for c in ("day", "ix", "iy")}
        if not n:
            return pa.table({**out, **{f"{name}_{v}": pa.array([], pa.float64()) for v in values for name in ("sum", "n")}})
        x0, y0 = (asked.column(c)[0].as_py() * tile for c in ("tx", "ty"))
        ix, iy = (asked.column(c).to_numpy() for c in ("ix", "iy"))
        lo_x, hi_x, lo_y, hi_y = (np.clip(v, 0, tile) for v in (ix - size // 2 - x0, ix + size - size // 2 - x0, iy - size // 2 - y0, iy + size - size // 2 - y0))
        col, row = (cells.column(c).to_numpy() for c in ("ix", "iy"))
        for v in values:
            found = cells.column(v).to_numpy(zero_copy_only=False).astype(float)
            good = ~np.isnan(found)
            for name, what in (("sum", found), ("n", np.ones(len(found)))):
                area = np.zeros((tile + 1, tile + 1))
                np.add.at(area, (row[good] - y0 + 1, col[good] - x0 + 1), what[good])
                area = area.cumsum(0).cumsum(1)
                out[f"{name}_{v}"] = pa.array(area[hi_y, hi_x] - area[lo_y, hi_x] - area[hi_y, lo_x] + area[lo_y, lo_x])
        return pa.table(out)

    return run


def chip_means(events: DataFrame, grid: DataFrame, values: list[str], size: int = 32, days: int = 60, tile: int = 128) -> DataFrame:
    """(day, ix, iy, values): mean of each value over the ``size`` by ``size`` chip around a cell, where the look-back of an event asks for it.

    ``events`` (ix, iy, date, ...), ``grid`` (day, ix, iy, values), both numbered from 0. Cells without a value
    do not count, chips end at the border, and a chip without any value is NULL. The grid is cut into
    tiles of ``tile`` cells a side; each tile of a day becomes one summed-area table, from which a chip needs four
    entries, or those of the four tiles it touches. Chips are asked for once for each (day, cell), so a tile has no
    more of them than cells nearby, and no event meets the cells of its chip.
    """
    known = grid.select(
        "day", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), *(F.col(v).cast("double").alias(v) for v in values))
    t = lambda c: F.floor(F.col(c) / tile)
    known = known.dropna(subset=["day", "ix", "iy"]).where("ix >= 0 AND iy >= 0").withColumns({"tx": t("ix"), "ty": t("iy")})
    spots = events.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "date").dropna().where("ix >= 0 AND iy >= 0").distinct()
    places = spots.select("ix", "iy", F.explode(F.sequence(F.date_sub("date", days - 1), F.col("date"), F.expr("INTERVAL 1 DAY"))).alias("day")).distinct()
    span = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - size // 2, F.lit(0)) / tile), F.floor((F.col(c) + size - size // 2 - 1) / tile)))
    asked = places.select("day", "ix", "iy").withColumn("tx", span("ix")).withColumn("ty", span("iy"))
    key, sums = ["day", "tx", "ty"], [f"{n}_{v}" for v in values for n in ("sum", "n")]
    schema = "day date, ix long, iy long, " + ", ".join(f"{c} double" for c in sums)
    parts = known.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_chip_sums(size, tile, values), schema)
    whole = parts.groupBy("day", "ix", "iy").agg(*(F.sum(c).alias(c) for c in sums))
    return whole.select("day", "ix", "iy", *(F.when(F.col(f"n_{v}") > 0.5, F.col(f"sum_{v}") / F.col(f"n_{v}")).alias(v) for v in values))


def chip_series(events: DataFrame, grid: DataFrame, values: list[str], size: int = 32, days: int = 60, tile: int = 128) -> DataFrame:
    """(events columns, lag, values): ``chip_means`` around an event's cell on each day back; an event without place or date has NULLs."""
    means = chip_means(events, grid, values, size, days, tile)
    return lookback(events, means, ["ix", "iy"], days).select(*events.columns, "lag", *values)


def chip_mean(long: DataFrame, key: list[str], value: str) -> DataFrame:
    return long.groupBy(*key).agg(F.avg(value).alias("chip_mean"))


def chip_mode(long: DataFrame, key: list[str], value: str) -> DataFrame:
    """Most frequent value per key, ties to the smallest; 0 if all are missing."""
    counts = long.groupBy(*key, value).agg(F.count(value).alias("_n"))
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col("_n").alias("n"), (-F.col(value)).alias("v"))))
    return counts.groupBy(*key).agg(best.alias("_b")).select(*key, F.coalesce(-F.col("_b.v"), F.lit(0)).alias("chip_mode"))


def time_channel_long(static: DataFrame, dynamic: DataFrame, key: str, channels: list[str], days: int) -> DataFrame:
    """(key, lag, channel, value): statics repeated on every lag, beside the dynamics."""
    names = [c for c in static.columns if c != key]
    spread = static.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).unpivot([key, "lag"], names, "channel", "value")
    return spread.unionByName(dynamic.select(key, "lag", *channels).unpivot([key, "lag"], channels, "channel", "value"))


def lookback_coverage(long: DataFrame, key: list[str], value: str, days: int) -> DataFrame:
    """Keys with fewer than ``days`` days that have a value."""
    return long.groupBy(*key).agg(F.count(value).alias("n_days")).where(F.col("n_days") < days)


def join_features(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``a`` with the features of ``b``; keys that either side lacks go."""
    return a.join(b, key)
