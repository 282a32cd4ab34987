"""Grid and spatial operators: equi-joins on integer cells with exact residual predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.polygons import kept
from emberframe.operators.ranks import exact_quantiles


def to_cell(df: DataFrame, x0: float, y0: float, res: float, nx: int, ny: int, x: str = "x", y: str = "y") -> DataFrame:
    """Nearest cell of each point, clamped to the grid (rows grow with y)."""
    clamp = lambda c, n: F.least(F.greatest(F.floor(c).cast("int"), F.lit(0)), F.lit(n - 1))
    return df.withColumn("ix", clamp((F.col(x) - x0) / res, nx)).withColumn("iy", clamp((F.col(y) - y0) / res, ny))


def chip(events: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """Cells of the ``size`` by ``size`` window [i - size/2, i + size/2) around each event's cell.

    A chip is put together once for each cell that has events; they meet it as one row and unfold it last. Spark
    takes unfolded rows for as few as they come from, and a chip for one cell, so the joins are told not to broadcast.
    """
    offs = F.sequence(F.lit(-(size // 2)), F.lit(size - size // 2 - 1))
    spread = events.select("ix", "iy").dropna().distinct().withColumn("_dx", F.explode(offs)).withColumn("_dy", F.explode(offs))
    spread = spread.select("ix", "iy", (F.col("ix") + F.col("_dx")).alias("cx"), (F.col("iy") + F.col("_dy")).alias("cy"))
    found = spread.hint("merge").join(cells.withColumnsRenamed({"ix": "cx", "iy": "cy"}), ["cx", "cy"])
    values = [c for c in cells.columns if c not in ("ix", "iy")]
    chips = found.groupBy("ix", "iy").agg(F.collect_list(F.struct("cx", "cy", *values)).alias("_chip"))
    own = [c for c in events.columns if c not in ("ix", "iy")]
    return events.join(chips.hint("merge"), ["ix", "iy"]).select(*own, F.inline("_chip")).select("cx", "cy", *own, *values)


def regrid(fine: DataFrame, coarse: DataFrame, factor: int) -> DataFrame:
    """Every fine cell with the value of the coarse cell that covers it."""
    return fine.withColumn("gx", F.floor(F.col("ix") / factor).cast("int")).withColumn("gy", F.floor(F.col("iy") / factor).cast("int")).join(coarse, ["gx", "gy"])


def within_distance(cells: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Keys (ix, iy) of ``cells`` (ix, iy, x, y) within ``radius`` of a point: buckets of that size, then the distance."""
    b = lambda c: F.floor(c / radius).cast("int")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = points.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct().withColumn("_ax", F.explode(near)).withColumn("_ay", F.explode(near))
    spread = spread.withColumn("bx", b(F.col("px")) + F.col("_ax")).withColumn("by", b(F.col("py")) + F.col("_ay")).drop("_ax", "_ay")
    keyed = cells.withColumn("bx", b(F.col("x"))).withColumn("by", b(F.col("y")))
    close = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 <= radius * radius
    return keyed.alias("c").join(spread.alias("p"), (F.col("c.bx") == F.col("p.bx")) & (F.col("c.by") == F.col("p.by")) & close, "left_semi").select("ix", "iy")


def exclude_within(cells: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    return cells.join(within_distance(cells, points, radius), ["ix", "iy"], "left_anti")


def sampling_area(cells: DataFrame, aoi: DataFrame, points: DataFrame, radius: float, risk: str) -> DataFrame:
    """Cells in the area of interest with a positive risk and outside the buffer."""
    inside = cells.join(aoi, ["ix", "iy"], "left_semi").where(F.col(risk) > 0)
    return exclude_within(inside, points, radius)


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against one fixed polygon, as a plain expression."""
    n = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            n = n + F.when((y >= min(y1, y2)) & (y < max(y1, y2)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)), 1).otherwise(0)
    return n % 2 == 1


def touched(x: Column, y: Column, half: float, ring: list[tuple[float, float]]) -> Column:
    """Does an edge of the polygon meet the closed square of half-width ``half`` around (x, y)?

    An edge and a square are apart if their extents are along x or y, or if all corners lie on one
    side of the edge's line.
    """
    hit = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        boxes = x.between(min(x1, x2) - half, max(x1, x2) + half) & y.between(min(y1, y2) - half, max(y1, y2) + half)
        across = F.abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) <= half * (abs(x2 - x1) + abs(y2 - y1))
        hit = hit | (boxes & across)
    return hit


def clip_cells(cells: DataFrame, ring: list[tuple[float, float]], half: float = 0.0) -> DataFrame:
    """Cells of (x, y) centres inside a polygon; with ``half``, all cells of that half-width that it touches.

    A cell is touched if its centre lies inside or an edge meets it, so a polygon thinner or smaller
    than a cell is not lost.
    """
    x, y = F.col("x"), F.col("y")
    return cells.where(inside(x, y, ring) | touched(x, y, half, ring) if half else inside(x, y, ring))


def focal_mean(cells: DataFrame, value: str, size: int = 4, min_periods: int | None = None) -> DataFrame:
    """Mean of the ``size`` by ``size`` window with offsets -size/2 .. size/2 - 1 around each cell.

    NULL where fewer than ``min_periods`` cells (default: all) have a value. Every cell adds itself
    to the windows it lies in, summed before the shuffle, so missing cells need no filling.
    """
    offs = F.sequence(F.lit(size // 2 - size + 1), F.lit(size // 2))
    spread = cells.where(F.col(value).isNotNull()).select("ix", "iy", value).withColumn("_dx", F.explode(offs)).withColumn("_dy", F.explode(offs))
    sums = spread.groupBy((F.col("ix") + F.col("_dx")).alias("ix"), (F.col("iy") + F.col("_dy")).alias("iy")).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    need = size * size if min_periods is None else min_periods
    return cells.select("ix", "iy").join(sums, ["ix", "iy"], "left").select("ix", "iy", F.when(F.col("_c") >= need, F.col("_s") / F.col("_c")).alias("focal"))


def coarsen(cells: DataFrame, value: str, k: int) -> DataFrame:
    """Mean of full k by k blocks; blocks with fewer cells are trimmed."""
    blocks = cells.groupBy(F.floor(F.col("ix") / k).cast("int").alias("bx"), F.floor(F.col("iy") / k).cast("int").alias("by"))
    return blocks.agg(F.avg(value).alias("block_mean"), F.count("*").alias("_n")).where(F.col("_n") == k * k).drop("_n")


def every_kth(cells: DataFrame, k: int) -> DataFrame:
    return cells.where((F.col("ix") % k == 0) & (F.col("iy") % k == 0))


def sample_at(points: DataFrame, cells: DataFrame) -> DataFrame:
    return points.join(cells, ["ix", "iy"], "left")


def prediction_grid(cells: DataFrame, template: str) -> DataFrame:
    return cells.where(F.col(template).isNotNull()).select("ix", "iy")


def zonal_stats(pred: DataFrame, zones: DataFrame, key: str, value: str, path: str | None = None) -> DataFrame:
    """Statistics per zone; the quantile is counted in buckets, since one zone may hold most rows.

    Three branches read the joined rows. With a ``path``, zone and value of each are written there, so the
    join and what ``zones`` comes from run once.
    """
    joined = pred.join(zones, key).select("zone_id", value)
    joined = joined if path is None else kept(joined, path)
    rest = joined.groupBy("zone_id").agg(F.avg(value).alias("mean_risk"), F.max(value).alias("max_risk"), F.stddev(value).alias("spatial_std"), F.count(value).alias("n"))
    tail = exact_quantiles(joined, value, {"p90": 0.9}, ["zone_id"])
    return rest.join(tail, "zone_id", "left").select("zone_id", "mean_risk", "max_risk", "spatial_std", "p90", "n")


def extent(df: DataFrame) -> DataFrame:
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common extent of two tables, and whether it is non-empty."""
    p, q = extent(a).alias("p"), extent(b).alias("q")
    both = p.crossJoin(q)  # one row each
    lo = lambda c: F.greatest(f"p.min_{c}", f"q.min_{c}")
    hi = lambda c: F.least(f"p.max_{c}", f"q.max_{c}")
    return both.select(lo("x").alias("min_x"), hi("x").alias("max_x"), lo("y").alias("min_y"), hi("y").alias("max_y"), ((lo("x") <= hi("x")) & (lo("y") <= hi("y"))).alias("overlaps"))


def crop(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return df.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
