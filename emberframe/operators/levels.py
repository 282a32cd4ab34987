"""Warning levels: binning, level statistics, trends and vulnerability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.scalar import season
from emberframe.operators.ranks import beside, exact_quantiles

LEVELS = ("Low", "Moderate", "High", "Very High", "Extreme")


def warning_level(score: Column, thresholds: list[float]) -> Column:
    """Number of thresholds at or below the score: 0 is the lowest level; bins are left-closed."""
    return F.when(score.isNotNull(), sum(((score >= t).cast("int") for t in sorted(thresholds)), F.lit(0)))


def level_stats(pred: DataFrame, by: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """Share of each level and mean, median, p90, p95, p99 and count per group."""
    level = warning_level(F.col(value), thresholds)
    shares = [(F.count_if(level == i) / F.count(value)).alias(f"share_{i}") for i in range(len(thresholds) + 1)]
    tail = exact_quantiles(pred, value, {"median_risk": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, by)
    got = beside(pred.groupBy(*by).agg(*shares, F.avg(value).alias("mean_risk"), F.count(value).alias("n")), tail, by, "left")
    return got.select(*by, *(f"share_{i}" for i in range(len(thresholds) + 1)), "mean_risk", "median_risk", "p90", "p95", "p99", "n")


def _beta_fraction(x: Column, a: Column, b: Column, terms: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last term up; it settles where x < (a + 1) / (a + b + 2)."""
    m = lambda i: F.floor(i / 2)
    even = lambda i: m(i) * (b - m(i)) * x / ((a + 2 * m(i) - 1) * (a + 2 * m(i)))
    odd = lambda i: -(a + m(i)) * (a + b + m(i)) * x / ((a + 2 * m(i)) * (a + 2 * m(i) + 1))
    return F.aggregate(F.sequence(terms, F.lit(1)), F.lit(1.0), lambda v, i: 1 + F.when(i % 2 == 0, even(i)).otherwise(odd(i)) / v)


# Series of gamma(z + 1/2) / gamma(z) / sqrt(z) in 1 / z (fixed values).
HALF_GAMMA = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)


def _beta_half(a: Column) -> Column:
    """B(a, 1/2): gamma(a + 1/2) / gamma(a) by its series at a + 16, brought down by the recurrence."""
    z = a + 16
    series = sum((F.lit(c) / F.pow(z, F.lit(float(k))) for k, c in enumerate(HALF_GAMMA)), F.lit(0.0))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(1.0), lambda v, i: v * (a + i) / (a + i + 0.5))
    return math.sqrt(math.pi) / (F.sqrt(z) * series * down)


def student_two_sided(t: Column, nu: Column) -> Column:
    """P(|T| >= |t|) for ``nu`` of 1 or more: the incomplete beta function of nu / (nu + t * t), in full relative precision.

    A small probability is the fraction itself, not what is left of 1, so it is right down to the smallest doubles.
    """
    t, nu = F.abs(t), nu.cast("double")
    a, half = nu / 2, F.lit(0.5)
    x, y = nu / (nu + t * t), t * t / (nu + t * t)
    front = F.exp(-a * F.log1p(t * t / nu)) * t / F.sqrt(nu + t * t) / _beta_half(a)
    terms = (40 + 4 * F.ceil(F.sqrt(nu))).cast("int")
    tail = front / (a * _beta_fraction(x, a, half, terms))
    rest = 1 - front / (half * _beta_fraction(y, half, a, terms))
    return F.when(nu >= 1, F.when(x < (a + 1) / (a + 2.5), tail).otherwise(F.greatest(rest, F.lit(0.0))))


def level_trends(stats: DataFrame, by: list[str], share: str, year: str, span: int = 60) -> DataFrame:
    """Linear trend of a share over years per group of two points or more: slope, r2, p-value, ends, change."""
    n = F.count(share)
    got = stats.groupBy(*by).agg(
        n.alias("n"), F.regr_slope(share, year).alias("slope"), F.regr_r2(share, year).alias("r2"), F.var_pop(share).alias("_v"),
        F.min_by(share, year).alias("first_share"), F.max_by(share, year).alias("last_share")).where("n >= 2")
    r2 = F.when(F.col("_v") > 0, F.col("r2")).otherwise(0.0)
    t = F.sqrt(r2 * (F.col("n") - 2) / F.greatest(1 - r2, F.lit(1e-300)))
    p = F.when(F.col("n") == 2, 1.0 - F.ceil(r2)).when(r2 >= 1, 0.0).otherwise(student_two_sided(t, (F.col("n") - 2).cast("int")))
    return got.select(*by, "n", "slope", r2.alias("r2"), p.alias("p_value"), "first_share", "last_share", (F.col("slope") * span).alias("projected_change"))


def zone_vulnerability(stats: DataFrame, share: str, base: int, future: int, months: list[int]) -> DataFrame:
    """High-risk share in two years per zone, absolute and relative increase; zones with both years only."""
    at = lambda y: F.avg(F.when(F.col("yr") == y, F.col(share)))
    got = stats.where(F.col("mon").isin(months)).groupBy("zone_id").agg(at(base).alias("base_share"), at(future).alias("future_share")).dropna()
    rise = F.col("future_share") - F.col("base_share")
    return got.select("zone_id", "base_share", "future_share", rise.alias("increase"), (F.try_divide(rise, F.col("base_share")) * 100).alias("increase_percent"))


def seasonal_vulnerability(stats: DataFrame, share: str, base: int, future: int) -> DataFrame:
    """Zone by season change in percentage points; missing is 0."""
    at = lambda y: F.avg(F.when(F.col("yr") == y, F.col(share)))
    d = stats.groupBy("zone_id", season(F.col("mon")).alias("_season")).agg(((at(future) - at(base)) * 100).alias("_d"))
    return d.groupBy("zone_id").pivot("_season", ["Winter", "Spring", "Summer", "Fall"]).agg(F.first("_d")).na.fill(0.0)


def level_evolution(stats: DataFrame, zones: DataFrame, n_levels: int) -> DataFrame:
    """Yearly mean share of each level over the given zones, and the running stack."""
    kept = stats.join(zones, "zone_id", "left_semi")
    wide = kept.groupBy("yr").agg(*(F.avg(f"share_{i}").alias(f"share_{i}") for i in range(n_levels)))
    stack = [sum((F.col(f"share_{j}") for j in range(i + 1)), F.lit(0.0)).alias(f"stack_{i}") for i in range(n_levels)]
    return wide.select("yr", *(f"share_{i}" for i in range(n_levels)), *stack)


def extreme_days(pred: DataFrame, history: DataFrame, by: list[str], q: float = 0.95) -> DataFrame:
    """Rows above the ``q`` quantile of a historical score set, counted per group."""
    limit = exact_quantiles(history, "score", {"_limit": q})
    return pred.crossJoin(F.broadcast(limit)).groupBy(*by).agg(F.count_if(F.col("score") > F.col("_limit")).alias("n_extreme"), F.count("*").alias("n"))
