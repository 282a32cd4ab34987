"""Queries of ensemble aggregation and warning levels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.operators import ensemble as C
from emberframe.operators import levels as L
from emberframe.plans.base import ENS, FACT, PRED, SEASON, ensemble, fact, predictions, rounded
from emberframe.plans.queries_tables import VERS, versions
from emberframe.sources.io import pair_versions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


QS = "round(quantile_cont(value, 0.25), 6) AS pctl25, round(quantile_cont(value, 0.5), 6) AS pctl50, round(quantile_cont(value, 0.75), 6) AS pctl75, round(quantile_cont(value, 0.99), 6) AS pctl99"


@query(f"WITH {ENS} SELECT scenario, variable, day, cell, {QS} FROM ens GROUP BY 1, 2, 3, 4")
def c01_ensemble_quantiles(spark, d):
    return rounded(C.ensemble_quantiles(ensemble(spark, d), ["scenario", "variable", "day", "cell"], "value"))


@query(f"WITH {ENS} SELECT DISTINCT member FROM ens WHERE variable = 'F' AND member IN (SELECT member FROM ens WHERE variable = 'O')")
def c02_common_members(spark, d):
    e = ensemble(spark, d)
    return C.common_members(e.where("variable = 'F'"), e.where("variable = 'O'"))


@query(f"WITH {ENS}, g AS (SELECT scenario, member, day, cell, variable, avg(value) AS v FROM ens GROUP BY ALL) SELECT a.scenario, a.member, a.day, a.cell, round(a.v, 6) AS \"value_F\", round(b.v, 6) AS \"value_O\" FROM g a JOIN g b ON a.scenario = b.scenario AND a.member = b.member AND a.day = b.day AND a.cell = b.cell WHERE a.variable = 'F' AND b.variable = 'O'")
def c03_pair_members(spark, d):
    return rounded(C.pair_members(ensemble(spark, d), ["scenario", "member", "day", "cell"], "variable", "value", "F", "O"))


@query(f"WITH {ENS}, q AS (SELECT scenario, cell, variable, {QS} FROM ens GROUP BY 1, 2, 3) SELECT scenario, cell, 'hot_dry' AS scenario_name, max(CASE WHEN variable = 'F' THEN pctl99 END) AS \"F\", max(CASE WHEN variable = 'O' THEN pctl25 END) AS \"O\" FROM q GROUP BY 1, 2 UNION ALL SELECT scenario, cell, 'middle', max(CASE WHEN variable = 'F' THEN pctl50 END), max(CASE WHEN variable = 'O' THEN pctl50 END) FROM q GROUP BY 1, 2")
def c04_percentile_scenarios(spark, d):
    q = C.ensemble_quantiles(ensemble(spark, d), ["scenario", "cell", "variable"], "value")
    return rounded(C.percentile_scenarios(q, ["scenario", "cell"], {"hot_dry": {"F": "pctl99", "O": "pctl25"}, "middle": {"F": "pctl50", "O": "pctl50"}}))


@query(f"WITH {ENS} SELECT scenario, variable, count(DISTINCT member) AS n_members FROM ens GROUP BY 1, 2")
def c05_member_inventory(spark, d):
    return C.member_inventory(ensemble(spark, d), ["scenario", "variable"])


VCMP = f"{VERS}, v AS (SELECT coalesce(a.g, b.g) AS g, a.v AS x, b.v AS y, a.k IS NULL OR b.k IS NULL AS single FROM a FULL JOIN b ON a.k = b.k AND a.g = b.g), s AS (SELECT g, count(CASE WHEN single THEN 1 END) AS n_one_sided, count(x + y) AS n_valid, avg(x) AS old_mean, avg(y) AS new_mean, avg(abs(y - x)) AS mean_abs, max(abs(y - x)) AS max_abs, avg(abs(y - x) / (abs(x) + 1e-10) * 100) AS mean_rel, sqrt(avg((y - x) * (y - x))) AS rmse FROM v GROUP BY 1), t AS (SELECT *, CASE WHEN n_valid = 0 THEN 'NO_VALID_DATA' WHEN n_one_sided > 0 THEN 'SHAPE_MISMATCH' WHEN max_abs < 1e-6 THEN 'IDENTICAL' WHEN mean_rel < 0.01 THEN 'VERY_SIMILAR' WHEN mean_rel < 1 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS status FROM s)"


def compared(spark, d):
    return C.compare_versions(pair_versions(*versions(spark, d), ["k", "g"], "v"), ["g"])


@query(f"WITH {VCMP} SELECT g, n_one_sided, n_valid, round(old_mean, 4) AS old_mean, round(new_mean, 4) AS new_mean, round(mean_abs, 4) AS mean_abs, round(max_abs, 4) AS max_abs, round(mean_rel, 4) AS mean_rel, round(rmse, 4) AS rmse, status FROM t")
def c06_compare_versions(spark, d):
    return rounded(compared(spark, d), 4)


@query(f"WITH {VCMP} SELECT status, count(*) AS n FROM t GROUP BY 1")
def c07_status_counts(spark, d):
    return C.status_counts(compared(spark, d))


DAYS = "dm AS (SELECT scenario, day, avg(value) AS m, sum(value) AS s FROM ens WHERE month(day) = 7 GROUP BY 1, 2)"


@query(f"WITH {ENS}, {DAYS} SELECT scenario, CAST(year(day) AS INT) AS yr, round(min(m), 6) AS lo, round(avg(m), 6) AS mean, round(max(m), 6) AS hi FROM dm GROUP BY 1, 2")
def c08_monthly_minmeanmax(spark, d):
    return rounded(C.monthly_minmeanmax(ensemble(spark, d), ["scenario"], "value", 7))


@query(f"WITH {ENS} SELECT scenario, CAST(year(day) AS INT) AS yr, round(avg(value), 6) AS month_mean FROM ens WHERE month(day) = 7 GROUP BY 1, 2")
def c09_month_mean(spark, d):
    return rounded(C.month_mean(ensemble(spark, d), ["scenario"], "value", 7))


@query(f"WITH {ENS}, {DAYS} SELECT scenario, CAST(year(day) AS INT) AS yr, round(sum(m), 6) AS month_total FROM dm GROUP BY 1, 2")
def c10_month_total(spark, d):
    return rounded(C.month_total(ensemble(spark, d), ["scenario"], "value", 7))


@query(f"WITH {ENS}, p AS (SELECT scenario, year(day) AS y, cell, sum(value) AS t FROM ens WHERE month(day) = 7 GROUP BY 1, 2, 3) SELECT scenario, CAST(y AS INT) AS yr, round(avg(t), 6) AS month_total FROM p GROUP BY 1, 2")
def c10_month_total_per_cell(spark, d):
    return rounded(C.month_total(ensemble(spark, d), ["scenario"], "value", 7, "cell_first"))


@query(f"WITH {ENS}, g AS (SELECT variable, day, avg(value) AS m, min(value) AS a, max(value) AS b FROM ens GROUP BY 1, 2) SELECT p.day, round(p.m, 6) AS mean_a, round(p.a, 6) AS min_a, round(p.b, 6) AS max_a, round(q.m, 6) AS mean_b, round(q.a, 6) AS min_b, round(q.b, 6) AS max_b FROM g p JOIN g q ON p.day = q.day WHERE p.variable = 'F' AND q.variable = 'O'")
def c11_daily_stats_pair(spark, d):
    e = ensemble(spark, d)
    return rounded(C.daily_stats_pair(e.where("variable = 'F'"), e.where("variable = 'O'"), "value"))


@query(f"WITH {ENS} SELECT scenario, CAST(year(day) AS INT) AS yr, round(avg(CASE WHEN variable = 'F' THEN value END), 6) AS \"F\", round(avg(CASE WHEN variable = 'O' THEN value END), 6) AS \"O\" FROM ens WHERE month(day) = 8 GROUP BY 1, 2")
def c12_climate_drivers(spark, d):
    return rounded(C.climate_drivers(ensemble(spark, d), ["scenario"], "variable", "value", 8, ["F", "O"]))


STATS = "round(avg(risk), 6) AS mean, round(stddev_samp(risk), 6) AS std, round(min(risk), 6) AS lo, round(max(risk), 6) AS hi"


@query(f"WITH {FACT} SELECT scenario, yr, {STATS} FROM fact GROUP BY 1, 2")
def c13_ensemble_stats(spark, d):
    return rounded(C.ensemble_stats(fact(spark, d), ["scenario", "yr"]))


@query(f"WITH {FACT}, m AS (SELECT yr, member, avg(risk) AS a FROM fact GROUP BY 1, 2) SELECT yr, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS std, count(*) AS n_members FROM m GROUP BY 1")
def c14_ensemble_stats_two_stage(spark, d):
    return rounded(C.ensemble_stats_two_stage(fact(spark, d), ["yr"]))


@query(f"WITH {FACT} SELECT yr, {STATS} FROM fact WHERE zone_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def c15_zone_filtered_stats(spark, d):
    zones = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 1").select(F.col("n_nationkey").alias("zone_id"))
    return rounded(C.ensemble_stats(C.for_zones(fact(spark, d), zones), ["yr"]))


@query(f"WITH {FACT}, z AS (SELECT yr, zone_id, stddev_samp(risk) AS s, avg(risk) AS m FROM fact GROUP BY 1, 2) SELECT yr, round(avg(s), 6) AS mean_std, round(avg(s / nullif(m, 0)), 6) AS mean_cv FROM z GROUP BY 1")
def c16_ensemble_cv(spark, d):
    return rounded(C.ensemble_cv(fact(spark, d), "yr"))


@query(f"WITH {FACT}, m AS (SELECT mon, member, round(avg(risk), 9) AS a FROM fact GROUP BY 1, 2), t AS (SELECT mon, member FROM (SELECT *, row_number() OVER (PARTITION BY mon ORDER BY a DESC, member) AS rn FROM m) WHERE rn = 1) SELECT f.mon, f.member, f.yr, round(avg(risk), 6) AS mean_risk FROM fact f JOIN t ON f.mon = t.mon AND f.member = t.member GROUP BY ALL")
def c17_worst_member(spark, d):
    return rounded(C.worst_member(fact(spark, d), "mon"))


CH = "p AS (SELECT zone_id, member, avg(CASE WHEN yr = 2000 THEN risk END) - avg(CASE WHEN yr = 1995 THEN risk END) AS d FROM fact GROUP BY 1, 2), ch AS (SELECT zone_id, avg(d) AS change FROM p WHERE d IS NOT NULL GROUP BY 1)"


@query(f"WITH {FACT}, {CH} SELECT zone_id, round(change, 6) AS change FROM ch")
def c18_zone_change(spark, d):
    return rounded(C.zone_change(fact(spark, d), 1995, 2000))


@query(f"WITH {FACT}, {CH}, r AS (SELECT zone_id, round(change, 9) AS c FROM ch) SELECT (SELECT zone_id FROM r ORDER BY c DESC, zone_id DESC LIMIT 1) AS max_zone, round((SELECT max(c) FROM r), 6) AS max_change, (SELECT zone_id FROM r ORDER BY c, zone_id LIMIT 1) AS min_zone, round((SELECT min(c) FROM r), 6) AS min_change")
def c18_extreme_zones(spark, d):
    return rounded(C.extreme_zones(C.zone_change(fact(spark, d), 1995, 2000)))


@query(f"WITH {FACT}, z AS (SELECT zone_id, yr, avg(risk) AS m FROM fact GROUP BY 1, 2) SELECT z.zone_id, z.yr, round(z.m, 6) AS mean_risk, round((z.m - b.m) / b.m * 100, 5) AS change_percent FROM z JOIN z b ON b.zone_id = z.zone_id AND b.yr = 1995")
def c19_change_from_baseline(spark, d):
    c = C.change_from_baseline(fact(spark, d), 1995)
    return rounded(c.withColumn("change_percent", F.round("change_percent", 5)))


@query(f"WITH {FACT}, z AS (SELECT scenario, zone_id, avg(CASE WHEN yr = 1995 THEN risk END) AS a, avg(CASE WHEN yr = 2000 THEN risk END) AS b FROM fact GROUP BY 1, 2), d AS (SELECT scenario, zone_id, round(b - a, 9) AS d FROM z WHERE a IS NOT NULL AND b IS NOT NULL) SELECT scenario, round(avg(d), 6) AS mean_change, round(quantile_cont(d, 0.5), 6) AS median_change, round(max(d), 6) AS max_change, round(min(d), 6) AS min_change, arg_max(zone_id, (d, zone_id)) AS max_zone, count(*) AS n_zones FROM d GROUP BY 1")
def c20_delta_by_scenario(spark, d):
    return rounded(C.delta_by_scenario(fact(spark, d), 1995, 2000))


@query(f"WITH {FACT}, z AS (SELECT zone_id, round(avg(risk), 9) AS m FROM fact WHERE yr = 2000 AND mon = 8 GROUP BY 1) SELECT zone_id, round(m, 6) AS mean_risk FROM z ORDER BY m DESC, zone_id LIMIT 10")
def c21_top_zones(spark, d):
    return rounded(C.top_zones(fact(spark, d).where("yr = 2000 AND mon = 8"), 10))


@query(f"WITH {FACT}, f AS (SELECT {SEASON.format('mon')} AS season, yr, member, risk FROM fact), a AS (SELECT season, yr, avg(risk) AS m, stddev_samp(risk) AS s FROM f GROUP BY 1, 2), b AS (SELECT season, yr, stddev_samp(x) AS sp FROM (SELECT season, yr, member, avg(risk) AS x FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT a.season, a.yr, round(m, 6) AS mean_risk, round(s, 6) AS std_risk, round(sp, 6) AS ensemble_spread, round(sp / m, 6) AS relative_uncertainty FROM a JOIN b ON a.season = b.season AND a.yr = b.yr")
def c22_province_summary(spark, d):
    return rounded(C.province_summary(fact(spark, d)))


@query(f"WITH {FACT}, z AS (SELECT {SEASON.format('mon')} AS season, yr, avg(risk) AS m, stddev_samp(risk) AS s FROM fact GROUP BY 1, 2) SELECT z.season, z.yr, round(z.m, 6) AS mean_risk, round(z.s, 6) AS std_risk, round(z.m / b.m, 6) AS ratio, round((z.m - b.m) / b.m * 100, 5) AS change_percent FROM z JOIN z b ON b.season = z.season AND b.yr = 1996")
def c23_season_vs_baseline(spark, d):
    c = C.season_vs_baseline(fact(spark, d), 1996)
    return rounded(c.withColumn("change_percent", F.round("change_percent", 5)))


@query(f"WITH {FACT}, z AS (SELECT zone_id, yr, avg(risk) AS m FROM fact GROUP BY 1, 2) SELECT round(quantile_cont(m, 0.01), 6) AS lo, round(quantile_cont(m, 0.99), 6) AS hi FROM z")
def c24_robust_limits(spark, d):
    return rounded(C.robust_limits(fact(spark, d), 0.01, 0.99))


@query(f"WITH {FACT}, z AS (SELECT zone_id, yr, avg(CASE WHEN scenario = 'A' THEN risk END) AS a, avg(CASE WHEN scenario = 'N' THEN risk END) AS n, avg(CASE WHEN scenario = 'R' THEN risk END) AS r FROM fact WHERE NOT (scenario = 'A' AND zone_id % 4 = 0) GROUP BY 1, 2) SELECT zone_id, yr, round(n, 6) AS median_risk, round(coalesce(a, n), 6) AS lower_risk, round(coalesce(r, n), 6) AS upper_risk FROM z")
def c25_quantile_band(spark, d):
    f = fact(spark, d).where("NOT (scenario = 'A' AND zone_id % 4 = 0)")
    return rounded(C.quantile_band(f, "scenario", ("A", "N", "R")))


@query("SELECT l_returnflag AS scenario, CAST(year(l_shipdate) AS INT) AS yr, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_tax), 6) AS mean_l_tax FROM lineitem GROUP BY 1, 2")
def c26_driver_series(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("yr", F.year("l_shipdate")).withColumnRenamed("l_returnflag", "scenario")
    return rounded(C.driver_series(li, ["scenario", "yr"], ["l_quantity", "l_tax"]))


@query(f"WITH {FACT} SELECT count(*) AS n_rows, count(DISTINCT member) AS n_member, count(DISTINCT yr) AS n_yr, count(DISTINCT mon) AS n_mon, count(DISTINCT zone_id) AS n_zone_id FROM fact")
def c27_fact_profile(spark, d):
    return C.fact_profile(fact(spark, d))


# warning levels

TH = [0.02, 0.04, 0.06, 0.08]
LEVEL = "(" + " + ".join(f"CAST(risk >= {t}::DOUBLE AS INT)" for t in TH) + ")"
LS = f"ls AS (SELECT zone_id, yr, mon, " + ", ".join(f"count(CASE WHEN {LEVEL} = {i} THEN 1 END) / CAST(count(risk) AS DOUBLE) AS share_{i}" for i in range(5)) + ", avg(risk) AS mean_risk, quantile_cont(risk, 0.5) AS median_risk, quantile_cont(risk, 0.9) AS p90, quantile_cont(risk, 0.95) AS p95, quantile_cont(risk, 0.99) AS p99, count(risk) AS n FROM fact GROUP BY 1, 2, 3)"


def stats(spark, d):
    return L.level_stats(fact(spark, d), ["zone_id", "yr", "mon"], "risk", TH)


def high(spark, d):
    return stats(spark, d).withColumn("high", F.col("share_3") + F.col("share_4"))


@query(f"WITH {FACT} SELECT {LEVEL} AS level, ['Low', 'Moderate', 'High', 'Very High', 'Extreme'][{LEVEL} + 1] AS label, count(*) AS n FROM fact GROUP BY 1, 2")
def l01_warning_level(spark, d):
    level = L.warning_level(F.col("risk"), TH)
    return fact(spark, d).groupBy(level.alias("level"), F.get(F.array(*map(F.lit, L.LEVELS)), level).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {FACT}, {LS} SELECT zone_id, yr, mon, " + ", ".join(f"round({c}, 6) AS {c}" for c in (*(f"share_{i}" for i in range(5)), "mean_risk", "median_risk", "p90", "p95", "p99")) + ", n FROM ls")
def l02_level_stats(spark, d):
    return rounded(stats(spark, d))


@query(f"WITH {FACT}, {LS}, h AS (SELECT zone_id, mon, yr, share_3 + share_4 AS high FROM ls) SELECT zone_id, mon, count(high) AS n, round(regr_slope(high, yr), 6) AS slope, round(CASE WHEN var_pop(high) > 0 THEN regr_r2(high, yr) ELSE 0 END, 6) AS r2, round(arg_min(high, yr), 6) AS first_share, round(arg_max(high, yr), 6) AS last_share, round(regr_slope(high, yr) * 60, 5) AS projected_change FROM h GROUP BY 1, 2 HAVING count(high) >= 2")
def l03_level_trends(spark, d):
    t = L.level_trends(high(spark, d), ["zone_id", "mon"], "high", "yr")
    return rounded(t.drop("p_value").withColumn("projected_change", F.round("projected_change", 5)))


# Student's two-sided probability in closed form, for the up to five degrees of freedom that seven years leave
PVAL = "CASE nu WHEN 1 THEN 1 - 2 * a / pi() WHEN 2 THEN 1 - sin(a) WHEN 3 THEN 1 - 2 / pi() * (a + sin(a) * cos(a)) WHEN 4 THEN 1 - sin(a) * (1 + cos(a) ** 2 / 2) WHEN 5 THEN 1 - 2 / pi() * (a + sin(a) * (cos(a) + 2 * cos(a) ** 3 / 3)) END"


@query(f"WITH {FACT}, {LS}, h AS (SELECT zone_id, mon, yr, share_3 + share_4 AS high FROM ls), r AS (SELECT zone_id, mon, count(high) AS n, CASE WHEN var_pop(high) > 0 THEN regr_r2(high, yr) ELSE 0 END AS r2 FROM h GROUP BY 1, 2 HAVING count(high) >= 2), t AS (SELECT *, n - 2 AS nu, atan(sqrt(r2 / greatest(1 - r2, 1e-300))) AS a FROM r) SELECT zone_id, mon, n, round(r2, 6) AS r2, round(CASE WHEN n = 2 THEN 1 - ceil(r2) WHEN r2 >= 1 THEN 0 ELSE {PVAL} END, 6) AS p_value FROM t")
def l03_trend_p_values(spark, d):
    """Two-sided p-values; tests hold long series against numeric integration."""
    return rounded(L.level_trends(high(spark, d), ["zone_id", "mon"], "high", "yr").select("zone_id", "mon", "n", "r2", "p_value"))


@query(f"WITH {FACT}, {LS}, h AS (SELECT zone_id, mon, yr, share_3 + share_4 AS high FROM ls), v AS (SELECT zone_id, avg(CASE WHEN yr = 1995 THEN high END) AS a, avg(CASE WHEN yr = 2000 THEN high END) AS b FROM h WHERE mon IN (7, 8) GROUP BY 1) SELECT zone_id, round(a, 6) AS base_share, round(b, 6) AS future_share, round(b - a, 6) AS increase, round((b - a) / nullif(a, 0) * 100, 5) AS increase_percent FROM v WHERE a IS NOT NULL AND b IS NOT NULL")
def l04_zone_vulnerability(spark, d):
    v = L.zone_vulnerability(high(spark, d), "high", 1995, 2000, [7, 8])
    return rounded(v.withColumn("increase_percent", F.round("increase_percent", 5)))


@query(f"WITH {FACT}, {LS}, h AS (SELECT zone_id, {SEASON.format('mon')} AS season, yr, share_3 + share_4 AS high FROM ls), v AS (SELECT zone_id, season, (avg(CASE WHEN yr = 2000 THEN high END) - avg(CASE WHEN yr = 1995 THEN high END)) * 100 AS d FROM h GROUP BY 1, 2) SELECT zone_id, " + ", ".join(f"round(coalesce(max(CASE WHEN season = '{s}' THEN d END), 0), 5) AS \"{s}\"" for s in ("Winter", "Spring", "Summer", "Fall")) + " FROM v GROUP BY 1")
def l05_seasonal_vulnerability(spark, d):
    return rounded(L.seasonal_vulnerability(high(spark, d), "high", 1995, 2000), 5)


@query(f"WITH {FACT}, {LS} SELECT yr, " + ", ".join(f"round(avg(share_{i}), 6) AS share_{i}" for i in range(5)) + ", " + ", ".join(f"round({' + '.join(f'avg(share_{j})' for j in range(i + 1))}, 6) AS stack_{i}" for i in range(5)) + " FROM ls WHERE zone_id < 10 GROUP BY 1")
def l06_level_evolution(spark, d):
    zones = spark.range(10).select(F.col("id").cast("int").alias("zone_id"))
    return rounded(L.level_evolution(stats(spark, d), zones, 5))


@query(f"WITH {PRED}, t AS (SELECT quantile_cont(score, 0.95) AS q FROM pred WHERE year(date) < 2022) SELECT CAST(year(date) AS INT) AS yr, count(CASE WHEN score > q THEN 1 END) AS n_extreme, count(*) AS n FROM pred, t WHERE year(date) >= 2022 GROUP BY 1")
def l07_extreme_days(spark, d):
    p = predictions(spark, d).withColumn("yr", F.year("date"))
    return L.extreme_days(p.where("yr >= 2022"), p.where("yr < 2022"), ["yr"])
