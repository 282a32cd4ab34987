"""Climate-ensemble aggregation and zone projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.scalar import pct_change, season
from emberframe.operators.ranks import exact_quantiles


def ensemble_quantiles(df: DataFrame, by: list[str], value: str, qs=(0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """Exact linear quantiles over members, one column ``pctl<q>`` each."""
    got = df.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, qs))).alias("_q"))
    return got.select(*by, *(F.col("_q")[i].alias(f"pctl{round(q * 100)}") for i, q in enumerate(qs)))


def common_members(a: DataFrame, b: DataFrame, key: str = "member") -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key)


def pair_members(df: DataFrame, on: list[str], variable: str, value: str, first: str, second: str) -> DataFrame:
    """Both variables of the same member, cell and day side by side."""
    side = lambda v: df.where(F.col(variable) == v).groupBy(*on).agg(F.avg(value).alias(f"{value}_{v}"))
    return side(first).join(side(second), on)


def percentile_scenarios(quantiles: DataFrame, on: list[str], table: dict[str, dict[str, str]]) -> DataFrame:
    """(scenario_name, one column per variable): each variable at its own quantile column.

    ``quantiles`` has ``on``, ``variable`` and the pctl columns; ``table`` maps a scenario's name to
    {variable: pctl column}.
    """
    out = None
    for name, picks in table.items():
        pick = F.coalesce(*(F.when(F.col("variable") == v, F.col(q)) for v, q in picks.items()))
        one = quantiles.groupBy(*on).agg(*(F.max(F.when(F.col("variable") == v, pick)).alias(v) for v in picks)).withColumn("scenario_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def member_inventory(df: DataFrame, by: list[str], member: str = "member") -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(member).alias("n_members"))


def compare_versions(paired: DataFrame, by: list[str]) -> DataFrame:
    """Statistics and status per group of (old_value, new_value, side).

    IDENTICAL below 1e-6 absolute, then VERY_SIMILAR below 0.01 %, SIMILAR below 1 % mean relative
    difference, else DIFFERENT; SHAPE_MISMATCH where a side lacks keys.
    """
    a, b = F.col("old_value"), F.col("new_value")
    rel = pct_change(b, a, "absolute")
    stats = paired.groupBy(*by).agg(
        F.count_if(F.col("side") != "BOTH").alias("n_one_sided"), F.count(a + b).alias("n_valid"), F.avg(a).alias("old_mean"), F.avg(b).alias("new_mean"),
        F.avg(F.abs(b - a)).alias("mean_abs"), F.max(F.abs(b - a)).alias("max_abs"), F.avg(rel).alias("mean_rel"), F.sqrt(F.avg((b - a) * (b - a))).alias("rmse"))
    status = (F.when(F.col("n_valid") == 0, "NO_VALID_DATA").when(F.col("n_one_sided") > 0, "SHAPE_MISMATCH").when(F.col("max_abs") < 1e-6, "IDENTICAL")
              .when(F.col("mean_rel") < 0.01, "VERY_SIMILAR").when(F.col("mean_rel") < 1, "SIMILAR").otherwise("DIFFERENT"))
    return stats.withColumn("status", status)


def status_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count("*").alias("n"))


def daily_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by, "day").agg(F.avg(value).alias("day_mean"))


def monthly_minmeanmax(df: DataFrame, by: list[str], value: str, month: int) -> DataFrame:
    """Spatial mean per day, then min, mean and max over the days of one month each year."""
    days = daily_mean(df.where(F.month("day") == month), by, value)
    return days.groupBy(*by, F.year("day").alias("yr")).agg(F.min("day_mean").alias("lo"), F.avg("day_mean").alias("mean"), F.max("day_mean").alias("hi"))


def month_mean(df: DataFrame, by: list[str], value: str, month: int) -> DataFrame:
    return df.where(F.month("day") == month).groupBy(*by, F.year("day").alias("yr")).agg(F.avg(value).alias("month_mean"))


def month_total(df: DataFrame, by: list[str], value: str, month: int, order: str = "space_first", cell: str = "cell") -> DataFrame:
    """Daily spatial means summed over the month, or totals per cell averaged over cells."""
    rows, yr = df.where(F.month("day") == month), F.year("day").alias("yr")
    if order == "space_first":
        return daily_mean(rows, by, value).groupBy(*by, yr).agg(F.sum("day_mean").alias("month_total"))
    per = rows.groupBy(*by, yr, cell).agg(F.sum(value).alias("_t"))
    return per.groupBy(*by, "yr").agg(F.avg("_t").alias("month_total"))


def daily_stats_pair(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    stats = lambda d, n: d.groupBy("day").agg(F.avg(value).alias(f"mean_{n}"), F.min(value).alias(f"min_{n}"), F.max(value).alias(f"max_{n}"))
    return stats(a, "a").join(stats(b, "b"), "day")


def climate_drivers(df: DataFrame, by: list[str], variable: str, value: str, month: int, variables: list[str]) -> DataFrame:
    """Scenario by year facts with one column per variable."""
    rows = df.where(F.month("day") == month).withColumn("yr", F.year("day"))
    return rows.groupBy(*by, "yr").pivot(variable, variables).agg(F.avg(value))


def driver_series(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(v).alias(f"mean_{v}") for v in values))


def ensemble_stats(df: DataFrame, by: list[str], value: str = "risk") -> DataFrame:
    """Mean, sample deviation, min and max over all zone and member rows."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def ensemble_stats_two_stage(df: DataFrame, by: list[str], value: str = "risk", member: str = "member") -> DataFrame:
    """Mean per member first, then mean and deviation over members."""
    return df.groupBy(*by, member).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("mean"), F.stddev("_m").alias("std"), F.count("*").alias("n_members"))


def for_zones(df: DataFrame, zones: DataFrame) -> DataFrame:
    return df.join(zones, "zone_id", "left_semi")


def ensemble_cv(df: DataFrame, by: str, zone: str = "zone_id", value: str = "risk") -> DataFrame:
    """Deviation and its share of the mean per zone, averaged over zones."""
    per = df.groupBy(by, zone).agg(F.stddev(value).alias("_s"), F.avg(value).alias("_m"))
    return per.groupBy(by).agg(F.avg("_s").alias("mean_std"), F.avg(F.try_divide("_s", "_m")).alias("mean_cv"))


def worst_member(df: DataFrame, by: str, member: str = "member", value: str = "risk") -> DataFrame:
    """Member of highest mean per group, the smaller id on ties, and its yearly series."""
    means = df.groupBy(by, member).agg(F.round(F.avg(value), 9).alias("_m"))
    top = means.groupBy(by).agg(F.max(F.struct("_m", (-F.col(member)).alias("_k"))).alias("_b")).select(by, (-F.col("_b._k")).alias(member))
    return df.join(F.broadcast(top), [by, member]).groupBy(by, member, "yr").agg(F.avg(value).alias("mean_risk"))  # one row per group


def zone_change(df: DataFrame, first: int, last: int, member: str = "member", value: str = "risk") -> DataFrame:
    """Mean over members of each zone's change between two years; members with both years only."""
    at = lambda y: F.avg(F.when(F.col("yr") == y, F.col(value)))
    per = df.where(F.col("yr").isin(first, last)).groupBy("zone_id", member).agg((at(last) - at(first)).alias("_d")).where("_d is not null")
    return per.groupBy("zone_id").agg(F.avg("_d").alias("change"))


def extreme_zones(changes: DataFrame) -> DataFrame:
    by = lambda f: F.expr(f"{f}(struct(round(change, 9) AS c, zone_id AS z))")
    return changes.agg(by("max").alias("a"), by("min").alias("b")).select(F.col("a.z").alias("max_zone"), F.col("a.c").alias("max_change"), F.col("b.z").alias("min_zone"), F.col("b.c").alias("min_change"))


def change_from_baseline(df: DataFrame, base: int, value: str = "risk") -> DataFrame:
    """Percent change of each zone and year to the zone's baseline year."""
    per = df.groupBy("zone_id", "yr").agg(F.avg(value).alias("mean_risk"))
    ref = per.where(F.col("yr") == base).select("zone_id", F.col("mean_risk").alias("_base"))
    return per.join(ref, "zone_id").select("zone_id", "yr", "mean_risk", pct_change(F.col("mean_risk"), F.col("_base")).alias("change_percent"))


def delta_by_scenario(df: DataFrame, first: int, last: int, value: str = "risk") -> DataFrame:
    """Change per scenario over its zones: mean, median, extremes and the zones that have them."""
    at = lambda y, n: df.where(F.col("yr") == y).groupBy("scenario", "zone_id").agg(F.avg(value).alias(n))
    d = at(first, "_a").join(at(last, "_b"), ["scenario", "zone_id"]).withColumn("_d", F.round(F.col("_b") - F.col("_a"), 9))
    return d.groupBy("scenario").agg(
        F.avg("_d").alias("mean_change"), F.percentile("_d", F.lit(0.5)).alias("median_change"), F.max("_d").alias("max_change"), F.min("_d").alias("min_change"),
        F.max(F.struct("_d", "zone_id"))["zone_id"].alias("max_zone"), F.count("*").alias("n_zones"))


def top_zones(df: DataFrame, n: int, value: str = "risk") -> DataFrame:
    per = df.groupBy("zone_id").agg(F.round(F.avg(value), 9).alias("mean_risk"))
    return per.orderBy(F.desc("mean_risk"), "zone_id").limit(n)


def province_summary(df: DataFrame, value: str = "risk", member: str = "member") -> DataFrame:
    """Per season and year: mean, deviation, spread of member means and relative uncertainty."""
    rows = df.withColumn("season", season(F.col("mon")))
    per = rows.groupBy("season", "yr", member).agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"), F.count(value).alias("_n"))
    # means and deviations over all rows follow from the members' sums, so rows are grouped once
    n, s, q = F.sum("_n"), F.sum("_s"), F.sum("_q")
    std = F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
    out = per.groupBy("season", "yr").agg((s / n).alias("mean_risk"), std.alias("std_risk"), F.stddev("_m").alias("ensemble_spread"))
    return out.withColumn("relative_uncertainty", F.try_divide("ensemble_spread", "mean_risk"))


def season_vs_baseline(df: DataFrame, base: int, value: str = "risk") -> DataFrame:
    """Season means by year beside the baseline year's: ratio and percent change."""
    per = df.groupBy(season(F.col("mon")).alias("season"), "yr").agg(F.avg(value).alias("mean_risk"), F.stddev(value).alias("std_risk"))
    ref = F.max(F.when(F.col("yr") == base, F.col("mean_risk"))).over(Window.partitionBy("season"))
    return per.select("season", "yr", "mean_risk", "std_risk", F.try_divide("mean_risk", ref).alias("ratio"), pct_change(F.col("mean_risk"), ref).alias("change_percent"))


def robust_limits(df: DataFrame, low: float, high: float, value: str = "risk") -> DataFrame:
    per = df.groupBy("zone_id", "yr").agg(F.avg(value).alias("_m"))
    return exact_quantiles(per, "_m", {"lo": low, "hi": high})


def quantile_band(df: DataFrame, quantile: str, names: tuple[str, str, str], value: str = "risk") -> DataFrame:
    """Median, lower and upper per zone and year; a missing quantile falls back to the median."""
    lower, mid, upper = names
    wide = df.groupBy("zone_id", "yr").pivot(quantile, list(names)).agg(F.avg(value))
    return wide.select("zone_id", "yr", F.col(mid).alias("median_risk"), F.coalesce(lower, mid).alias("lower_risk"), F.coalesce(upper, mid).alias("upper_risk"))


def fact_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *(F.count_distinct(c).alias(f"n_{c}") for c in ("member", "yr", "mon", "zone_id")))
