"""Validation of predictions. Global ranks run over distinct scores, in two levels, not over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.scalar import pct_change, season
from emberframe.operators.ranks import running

SEASONS = ("Winter", "Spring", "Summer", "Fall")


def count_by_period(pred: DataFrame, period: str, label: str = "label", score: str = "score") -> DataFrame:
    """Observed and expected counts per month or season; empty seasons stay, with 0."""
    if period == "month":
        return pred.groupBy(F.month("date").alias("period")).agg(F.sum(label).alias("observed"), F.sum(score).alias("expected"))
    spark = pred.sparkSession
    dim = spark.createDataFrame([(i, s) for i, s in enumerate(SEASONS)], "ord int, period string")
    got = pred.groupBy(season(F.month("date")).alias("period")).agg(F.sum(label).alias("observed"), F.sum(score).alias("expected"))
    return dim.join(got, "period", "left").select("period", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0.0)).alias("expected"))


def pearson(a: str, b: str) -> Column:
    """Correlation; NULL where either side is constant: merged partial means can give such a side a deviation of some 1e-16."""
    varies = lambda c: (F.min(c) < F.max(c)) & (F.stddev_pop(c) > 0)
    return F.when(varies(a) & varies(b), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank of each row's value (ties share one), from counts per distinct value."""
    counts = running(df.groupBy(column).agg(F.count("*").alias("_n")), column, ["_n"])
    ranks = counts.select(F.col(column).alias("_v"), (F.col("cum__n") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, rho_sq) by average ranks."""
    ranked = average_rank(average_rank(df.select(a, b), a, "_ra"), b, "_rb")
    return ranked.agg(pearson("_ra", "_rb").alias("rho")).withColumn("rho_sq", F.col("rho") * F.col("rho"))


def fit_errors(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """(r2, rmse, mae) with r2 = 1 - SSE / SST."""
    err = F.col(obs) - F.col(pred)
    return df.agg(
        F.sum(err * err).alias("_sse"), (F.var_pop(obs) * F.count(obs)).alias("_sst"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
    ).select((1 - F.try_divide("_sse", "_sst")).alias("r2"), "rmse", "mae")


def scale_analysis(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """Scale factor sum(obs) / sum(pred), and the errors before and after scaling."""
    factor = df.agg(F.try_divide(F.sum(obs), F.sum(pred)).alias("scale"))
    scaled = df.crossJoin(factor).withColumn("_p", F.col(pred) * F.col("scale"))  # one row
    after = fit_errors(scaled, obs, "_p").select(*(F.col(c).alias(f"{c}_scaled") for c in ("r2", "rmse", "mae")))
    both = factor.crossJoin(fit_errors(df, obs, pred)).crossJoin(after)
    return both.withColumn("rmse_change", F.col("rmse_scaled") - F.col("rmse"))


def cumulative(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, own_tp, own_fp, tp, fp, pos, neg) at every distinct score from the highest: the base of all curves."""
    by = pred.groupBy(F.col(score).alias("score")).agg(F.sum(label).alias("own_tp"), (F.count("*") - F.sum(label)).alias("own_fp"))
    every = by.agg(F.sum("own_tp").alias("pos"), F.sum("own_fp").alias("neg"))
    return running(by, "score", ["own_tp", "own_fp"], True).withColumnsRenamed({"cum_own_tp": "tp", "cum_own_fp": "fp"}).crossJoin(F.broadcast(every))  # one row


def roc_curve(pred: DataFrame) -> DataFrame:
    return cumulative(pred).select("score", F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))


def roc_auc(pred: DataFrame) -> DataFrame:
    """Mann-Whitney with half weight for ties."""
    wins = F.sum(F.col("own_tp") * (F.col("neg") - F.col("fp")) + F.col("own_tp") * F.col("own_fp") / 2.0)
    return cumulative(pred).agg(F.try_divide(wins, F.max(F.col("pos") * F.col("neg"))).alias("auc"))


def pr_curve(pred: DataFrame) -> DataFrame:
    """(score, precision, recall, gain): gain is the recall that the score itself adds."""
    return cumulative(pred).select(
        "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "pos").alias("recall"), F.try_divide("own_tp", "pos").alias("gain"))


def average_precision(pred: DataFrame) -> DataFrame:
    """Sum of precision over the recall it adds."""
    return pr_curve(pred).agg(F.sum(F.col("gain") * F.col("precision")).alias("ap"))


def max_f1(pred: DataFrame) -> DataFrame:
    """Best F1 and its threshold, the highest one on ties; an undefined F1 is 0."""
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return pr_curve(pred).select("score", f1.alias("f1")).agg(F.max(F.struct("f1", "score")).alias("b")).select("b.f1", F.col("b.score").alias("threshold"))


def calibration(pred: DataFrame, bins: int = 10, top: float | None = None) -> DataFrame:
    """Equal bins on [0, top] (default: the largest score), the last closed; an empty bin shows its centre."""
    limit = pred.agg(F.lit(top).cast("double").alias("_top") if top else F.max("score").alias("_top"))
    at = F.least(F.floor(F.try_divide(F.col("score"), F.col("_top")) * bins), F.lit(bins - 1)).cast("int")
    got = pred.crossJoin(F.broadcast(limit)).groupBy(at.alias("bin")).agg(F.avg("label").alias("_y"), F.avg("score").alias("_p"), F.count("*").alias("_n"))  # one row
    every = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(limit)
    centre = (F.col("bin") + 0.5) * F.col("_top") / bins
    return every.join(got, "bin", "left").select("bin", F.coalesce("_y", centre).alias("mean_label"), F.coalesce("_p", centre).alias("mean_score"), F.coalesce("_n", F.lit(0)).alias("n"))


def lift_curve(pred: DataFrame, key: str, percents: list[int]) -> DataFrame:
    """Lift and captured share of positives in the top p percent, n = floor(N p / 100); NULL for n = 0.

    Counts per distinct score settle all scores but the one at which a percentage cuts. A score's row has
    the percentages whose n falls on it, a row per percentage in all; only the rows of scores that one cuts
    are ranked by key.
    """
    by = pred.groupBy("score").agg(F.count("*").alias("_n"), F.sum("label").alias("_y"))
    totals = F.broadcast(by.agg(F.sum("_n").alias("_all"), F.sum("_y").alias("_pos")))  # one row
    wanted = lambda p: F.floor(F.col("_all") * p / 100)
    above = F.col("cum__n") - F.col("_n")
    here = F.filter(F.array(*map(F.lit, percents)), lambda p: (wanted(p) > above) & (wanted(p) <= F.col("cum__n")))
    summed = running(by, "score", ["_n", "_y"], True).crossJoin(totals)
    edges = summed.select(
        "score", (F.col("cum__y") - F.col("_y")).alias("_above_y"), "_y", (F.col("cum__n")).alias("_upto"), above.alias("_above"), "_all", F.explode(here).alias("percent"))
    edges = edges.select(
        "percent", "score", (wanted(F.col("percent")) - F.col("_above")).alias("_room"),
        F.when(wanted(F.col("percent")) == F.col("_upto"), F.col("_y")).alias("_whole"), "_above_y")
    cut = F.broadcast(edges.where("_whole is null").select("score", "percent", "_room"))  # a row per percentage at most
    tied = pred.join(F.broadcast(edges.where("_whole is null").select("score").distinct()), "score")
    placed = running(tied.groupBy("score", F.col(key).alias("_key")).agg(F.sum("label").alias("_y"), F.count("*").alias("_n")), "_key", ["_n"], group=["score"])
    partly = placed.join(cut, "score").groupBy("percent").agg(F.sum(F.when(F.col("cum__n") <= F.col("_room"), F.col("_y")).otherwise(0)).alias("_part"))
    every = pred.sparkSession.createDataFrame([(p,) for p in percents], "percent int").crossJoin(totals)
    hits = F.col("_above_y") + F.coalesce("_whole", "_part", F.lit(0))
    return every.join(F.broadcast(edges), "percent", "left").join(F.broadcast(partly), "percent", "left").select(
        "percent", wanted(F.col("percent")).alias("n"), (F.try_divide(hits, wanted(F.col("percent"))) / F.try_divide("_pos", "_all")).alias("lift"), F.try_divide(hits, "_pos").alias("captured"))


def class_balance(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg("label").alias("prevalence"), F.try_divide(F.count("*") - F.sum("label"), F.sum("label")).alias("negatives_per_positive"))


def overlap_period(a: DataFrame, b: DataFrame, on_common_ids: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the common range of their dates, and to the ids of column ``on_common_ids`` that both then have."""
    lim = lambda d, n: d.agg(F.min("date").alias(f"lo{n}"), F.max("date").alias(f"hi{n}"))
    both = lim(a, 1).crossJoin(lim(b, 2)).select(F.greatest("lo1", "lo2").alias("_lo"), F.least("hi1", "hi2").alias("_hi"))
    cut = lambda d: d.crossJoin(F.broadcast(both)).where(F.col("date").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    a, b = cut(a), cut(b)
    if on_common_ids:
        only = lambda d, other: d.join(other.select(on_common_ids), on_common_ids, "left_semi")
        a, b = only(a, b), only(b, a)
    return a, b


def compare_models(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """Side by side from (model, metric, value): improvement and percent change."""
    wide = metrics.groupBy("metric").pivot("model", [base, other]).agg(F.first("value"))
    return wide.select("metric", F.col(base).alias("base_value"), F.col(other).alias("other_value"), (F.col(other) - F.col(base)).alias("improvement"), pct_change(F.col(other), F.col(base)).alias("pct_change"))


def recommend(compared: DataFrame, strong: float = 5.0, weak: float = 1.0) -> DataFrame:
    m = F.col("mean_change")
    return compared.agg(F.avg("pct_change").alias("mean_change")).withColumn("verdict", F.when(m > strong, "use").when(m > weak, "marginal").otherwise("no"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def cv_summary(folds: DataFrame, value: str) -> DataFrame:
    """Folds, valid folds, mean and population deviation; NaN folds do not count."""
    good = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    return folds.agg(F.count("*").alias("n_folds"), F.count(good).alias("n_valid"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"))


def roc_band(curves: DataFrame, points: int = 100) -> DataFrame:
    """Mean and deviation of fold curves (fold, fpr, tpr) on a common grid, by linear interpolation."""
    w = Window.partitionBy("fold").orderBy("fpr")
    steps = curves.groupBy("fold", "fpr").agg(F.max("tpr").alias("tpr"))
    ends = steps.select("fold").distinct().select("fold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    steps = steps.unionByName(ends).groupBy("fold", "fpr").agg(F.max("tpr").alias("tpr"))
    seg = steps.withColumns({"_f2": F.lead("fpr").over(w), "_t2": F.lead("tpr").over(w)}).where("_f2 is not null")
    first, last = F.ceil(F.round(F.col("fpr") * (points - 1), 9)), F.ceil(F.round(F.col("_f2") * (points - 1), 9)) - F.when(F.col("_f2") >= 1, 0).otherwise(1)
    on = seg.where(first <= last).withColumn("_g", F.explode(F.sequence(first, last))).withColumn("_x", F.col("_g") / (points - 1))
    y = F.col("tpr") + (F.col("_t2") - F.col("tpr")) * (F.col("_x") - F.col("fpr")) / (F.col("_f2") - F.col("fpr"))
    return on.groupBy(F.col("_g").cast("int").alias("grid")).agg(F.avg(y).alias("mean_tpr"), F.stddev_pop(y).alias("std_tpr"))


def event_rates(events: DataFrame, area: float, cells: int) -> DataFrame:
    """Events per year, per day, per 100 units of area a year, and per cell-day."""
    days = F.datediff(F.max("date"), F.min("date")) + 1
    n = F.count("*")
    return events.agg(n.alias("n_events"), days.alias("n_days"), (n / (days / 365.25)).alias("per_year"), (n / days).alias("per_day"), (n / (days / 365.25) / area * 100).alias("per_100_area_year"), (n / days / cells).alias("per_cell_day"))


def relative_risk(pred: DataFrame, train: DataFrame) -> DataFrame:
    mean = train.agg(F.avg("score").alias("_mean"))
    return pred.crossJoin(F.broadcast(mean)).withColumn("relative_risk", F.try_divide("score", "_mean")).drop("_mean")


def expected_events(pred: DataFrame, grain: str = "week") -> DataFrame:
    return pred.groupBy(F.trunc("date", grain).alias("start")).agg(F.sum("score").alias("expected"), F.count("*").alias("n"))


def period_rate(pred: DataFrame, by: list[str]) -> DataFrame:
    """Expected events a year over the days each group covers."""
    days = F.datediff(F.max("date"), F.min("date")) + 1
    return pred.groupBy(*by).agg((F.sum("score") / (days / 365.25)).alias("rate"))


def scenario_change(rates: DataFrame, by: str, base: str) -> DataFrame:
    ref = rates.where(F.col(by) == base).select(F.col("rate").alias("_base"))
    return rates.crossJoin(F.broadcast(ref)).select(by, "rate", pct_change(F.col("rate"), F.col("_base")).alias("change_percent"))


def credible_interval(by_draw: DataFrame, block: int = 10) -> DataFrame:
    """Mean and 95 percent interval of totals per block of draws, from (draw, score)."""
    totals = by_draw.groupBy(F.floor(F.col("draw") / block).alias("block")).agg((F.sum("score") / F.count_distinct("draw")).alias("total"))
    return totals.agg(F.avg("total").alias("mean_total"), F.percentile("total", F.lit(0.025)).alias("low"), F.percentile("total", F.lit(0.975)).alias("high"))


def regional_summary(pred: DataFrame, region: str) -> DataFrame:
    return pred.groupBy(region).agg(F.avg("score").alias("mean_probability"), F.sum(F.col("score") * 365).alias("yearly_expected"))
