"""Scaling, grouping, fitting and scoring of the grouped logistic model."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.lookback import WINDOWS, day_windows, join_features
from emberframe.operators.ranks import exact_quantiles
from emberframe.sources.io import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this repository

# Feature families: name parts that mark them (fixed values, tried in this order).
STATIC_FAMILIES = {
    "static_topo": ("slope", "aspect", "northness", "eastness", "nasadem", "tri"),
    "static_veg": ("treecoverdensity", "landcover", "flammability"),
    "static_human": ("walking_time", "distroads"),
}
# Window suffix -> part of the group's name (fixed values); other windows are "medium".
SPANS = {"60d": "60d", "30d": "30d", "1d": "1d", "3d": "short", "5d": "short"}


def feature_group(name: str, dynamic: dict[str, str]) -> str:
    """Group of one feature; ``dynamic`` maps a variable's prefix to its family, e.g. {"T": "temp"}."""
    low = name.lower()
    for prefix, family in dynamic.items():
        if f"{prefix.lower()}_" in low:
            return f"{family}_{SPANS.get(low.rsplit('_', 1)[-1], 'medium')}"
    hit = [g for g, parts in STATIC_FAMILIES.items() if any(p in low for p in parts)]
    return hit[0] if hit else "static_other"


def feature_groups(names: list[str], dynamic: dict[str, str] | None = None) -> dict[str, str]:
    return {n: feature_group(n, dynamic or {"T": "temp", "P": "precip"}) for n in names}


def fit_scaler(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(feature, mean, std): population deviation, 1 where it is 0; one aggregation."""
    aggs = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]
    wide = df.groupBy(*(by or [])).agg(*aggs) if by else df.agg(*aggs)
    long = wide.unpivot(by or [], columns, "feature", "s")
    return long.select(*(by or []), "feature", "s.mean", F.when(F.col("s.std") > 0, F.col("s.std")).otherwise(1.0).alias("std"))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Standardised columns; the scaler is one row per feature, so it travels as constants."""
    s = {r.feature: (r["mean"], r["std"]) for r in scaler.collect()}
    return df.withColumns({c: (F.col(c) - F.lit(s[c][0])) / F.lit(s[c][1]) for c in columns})


def fold_draw(alpha: float, beta: list[float], attention: list[float], mean: list[float], std: list[float], scale: float = 1.0, use_scale: bool = False) -> tuple[float, list[float]]:
    """Scaler and attention folded into one intercept and one weight per feature.

    ``use_scale`` multiplies the attention by its fitted ``scale`` as the likelihood does; published scores leave it out.
    """
    k = scale if use_scale else 1.0
    w = [k * a * b / s for a, b, s in zip(attention, beta, std)]
    return alpha - sum(x * m for x, m in zip(w, mean)), w


def draw_probabilities(columns: list[str], draws: list[tuple[float, list[float]]]) -> list[Column]:
    """One probability column per draw: an unrolled sum of products, so it stays inside code generation."""
    out = []
    for alpha, w in draws:
        z = F.lit(float(alpha))
        for c, v in zip(columns, w):
            z = z + F.col(c) * F.lit(float(v))
        out.append(1 / (1 + F.exp(-z)))
    return out


def score(df: DataFrame, columns: list[str], draws: list[tuple[float, list[float]]], keep: list[str]) -> DataFrame:
    """Mean and population deviation of the draws' probabilities, as plain sums inside each row.

    For up to a few dozen draws; ``score_many`` takes hundreds.
    """
    names = [f"_p{i}" for i in range(len(draws))]
    wide = df.select(*keep, *(p.alias(n) for n, p in zip(names, draw_probabilities(columns, draws))))
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(draws)
    off = lambda n: (F.col(n) - F.col("mean_probability")) * (F.col(n) - F.col("mean_probability"))
    return wide.withColumn("mean_probability", mean).select(
        *keep, "mean_probability", F.sqrt(sum((off(n) for n in names), F.lit(0.0)) / len(draws)).alias("std_probability"))


def score_many(df: DataFrame, columns: list[str], draws: list[tuple[float, list[float]]], keep: list[str]) -> DataFrame:
    """``score`` for hundreds of draws: one matrix product per Arrow batch."""
    import numpy as np
    import pyarrow as pa

    alpha, w = np.array([d[0] for d in draws]), np.array([d[1] for d in draws])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + ["mean_probability double", "std_probability double"])

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(columns))], axis=1)
            p = 1 / (1 + np.exp(-(x @ w.T + alpha)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(p.mean(1)), pa.array(p.std(1))], names=[*keep, "mean_probability", "std_probability"])

    return df.select(*keep, *(F.col(c).cast("double") for c in columns)).mapInArrow(run, schema)


def score_timeseries(long: DataFrame, weights: DataFrame, attention: DataFrame, alphas: DataFrame, key: str) -> DataFrame:
    """Mean over draws of sigmoid(alpha + sum over lags of attention times sum over channels of x beta).

    ``long`` (key, lag, channel, value); ``weights`` (draw, channel, beta); ``attention`` (draw, lag,
    tau); ``alphas`` (draw, alpha). The small tables have draws x channels and draws x lags rows: they fold
    into one row per lag and channel with a weight per draw, so rows are not multiplied by draws.
    """
    intercept = {r.draw: r.alpha for r in alphas.select("draw", "alpha").collect()}  # the model's draws
    names = {f"_z{i}": k for i, k in enumerate(sorted(intercept))}
    folded = weights.join(attention, "draw").groupBy("lag", "channel").pivot("draw", list(names.values())).agg(F.sum(F.col("beta") * F.col("tau")))
    folded = folded.toDF("lag", "channel", *names)
    z = long.join(F.broadcast(folded), ["lag", "channel"]).groupBy(key).agg(*(F.sum(F.col("value") * F.col(n)).alias(n) for n in names))  # lags x channels rows
    p = [1 / (1 + F.exp(-(F.lit(float(intercept[k])) + F.col(n)))) for n, k in names.items()]
    total, seen = (sum(c, F.lit(0.0)) for c in ((F.coalesce(q, F.lit(0.0)) for q in p), (q.isNotNull().cast("double") for q in p)))
    return z.select(key, F.try_divide(total, seen).alias("mean_probability"))


def bernoulli_summary(pred: DataFrame, keep: list[str]) -> DataFrame:
    """Mean and deviation of the predicted 0/1 outcome, in closed form."""
    p = F.col("mean_probability")
    return pred.select(*keep, p.alias("outcome_mean"), F.sqrt(p * (1 - p)).alias("outcome_std"))


def attention_ranking(draws: DataFrame) -> DataFrame:
    """Mean attention per group over draws (draw, grp, weight), ranked."""
    mean = draws.groupBy("grp").agg(F.avg("weight").alias("mean_attention"))
    ordered = mean.agg(F.sort_array(F.collect_list("mean_attention"), asc=False).alias("_all"))  # one value per group
    return mean.crossJoin(F.broadcast(ordered)).withColumn("rnk", F.array_position("_all", F.col("mean_attention")).cast("int")).drop("_all")


def draw_diagnostics(draws: DataFrame, alphas: DataFrame) -> DataFrame:
    """How often each group leads a draw, and the baseline probability at the mean intercept."""
    top = draws.groupBy("draw").agg(F.max_by("grp", "weight").alias("grp")).groupBy("grp").agg(F.count("*").alias("n_draws"))
    base = alphas.agg((1 / (1 + F.exp(-F.avg("alpha")))).alias("baseline_probability"))
    return top.crossJoin(base)


def prediction_summary(pred: DataFrame, limit: float = 0.15) -> DataFrame:
    p, s = "mean_probability", "std_probability"
    rest = pred.agg(
        F.avg(p).alias("mean_p"), F.min(p).alias("min_p"), F.max(p).alias("max_p"), F.avg(s).alias("mean_std"),
        F.count_if(F.col(s) > limit).alias("n_uncertain"))
    return rest.crossJoin(exact_quantiles(pred, p, {"median_p": 0.5})).select("mean_p", "median_p", "min_p", "max_p", "mean_std", "n_uncertain")  # one row each


# Distribution function of Poisson(1) at 0 to 6 (fixed values): a uniform draw's count is how many of them it exceeds.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def poisson_counts(keys, draw: int, seed: int):
    """Poisson(1) counts of rows by their keys' hashes (int64): the same on any partitioning."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + draw + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(np.array(POISSON), u, side="left").astype(float)


def _newton_sums(seed: int, betas, bootstrap: bool):
    """For batches (key, label, columns): each draw's loss, gradient and curvature, summed over the task."""
    import numpy as np
    import pyarrow as pa

    draws, k = betas.shape

    def run(batches):
        total = np.zeros((draws, 1 + k + k * k))
        for batch in batches:
            keys, y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack([np.ones(len(y)), *x]) if len(y) else np.zeros((0, k))
            for d in range(draws):
                w, z = poisson_counts(keys, d, seed) if bootstrap else np.ones(len(y)), x @ betas[d]
                p = 1 / (1 + np.exp(-z))
                total[d, 0] += w @ (np.logaddexp(0, z) - y * z)
                total[d, 1 : 1 + k] += x.T @ (w * (p - y))
                total[d, 1 + k :] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(list(total))], names=["draw", "sums"])

    return run


def fit_draws(
    train: DataFrame, columns: list[str], label: str, prior: dict[str, float], n_draws: int, key: str, seed: int = 1, alpha_prior: float | None = 2.0, rounds: int = 50, bootstrap: bool = True,
) -> list[tuple[float, list[float]]]:
    """(alpha, coefficients) per bootstrap draw of the logistic model with Gaussian priors, at its mode.

    A draw weights rows by Poisson counts, drawn by hash of ``key`` (``bootstrap=False``: by 1), and adds half of (coefficient / prior
    deviation) squared to the loss; ``alpha_prior`` is the intercept's deviation, None leaves it free. All draws
    go through one pass of the rows per Newton round: a task sums each draw's gradient and curvature, which
    are added up by draw and solved on the driver, a matrix of columns by columns each. A step that
    raises a draw's loss is halved. Rows with a null count in no draw. An approximation of a posterior, not a
    sampler of it.
    """
    import numpy as np

    ready = train.select(F.xxhash64(key).alias("_id"), F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna().persist()
    k = len(columns) + 1
    shrink = np.array([0.0 if alpha_prior is None else alpha_prior**-2, *(prior[c] ** -2 for c in columns)])
    kept, step, loss = np.zeros((n_draws, k)), np.zeros((n_draws, k)), np.full(n_draws, np.inf)
    try:
        for _ in range(rounds):
            now = kept + step
            sums = ready.mapInArrow(_newton_sums(seed, now, bootstrap), "draw long, sums array<double>").select("draw", F.posexplode("sums").alias("at", "s"))
            total = np.zeros((n_draws, 1 + k + k * k))
            for r in sums.groupBy("draw", "at").agg(F.sum("s").alias("s")).collect():  # draws x columns squared
                total[r.draw, r.at] = r.s
            found = total[:, 0] + 0.5 * (now**2 * shrink).sum(1)
            better = found <= loss + 1e-12 * np.abs(found)
            kept, loss = np.where(better[:, None], now, kept), np.where(better, found, loss)
            slope = total[:, 1 : 1 + k] + now * shrink
            curve = total[:, 1 + k :].reshape(n_draws, k, k) + np.diag(shrink)
            newton = np.stack([-np.linalg.lstsq(c, g, rcond=None)[0] for c, g in zip(curve, slope)])
            step = np.where(better[:, None], newton, step / 2)
            if np.abs(step).max() <= 1e-10 * (1 + np.abs(kept).max()):
                break
    finally:
        ready.unpersist()
    return [(float(b[0]), [float(v) for v in b[1:]]) for b in kept]


def projection_dates(climate: DataFrame, months: list[int] | None = None, day: int = 15) -> DataFrame:
    """(date): the given day of every month that ``climate`` has days of, of ``months`` only if given."""
    start = climate.where(F.col("day").isNotNull()).select(F.trunc("day", "month").alias("start")).distinct()
    wanted = start if months is None else start.where(F.month("start").isin(months))
    return wanted.select(F.date_add("start", day - 1).alias("date"))


def member_features(
    climate: DataFrame, dates: DataFrame, on: list[str], variables: list[str], columns: list[str], members: list[str] | None = None, windows=WINDOWS, days: int = 60,
) -> DataFrame:
    """(members, ``on``, date, features): look-backs on every date of each coarse cell that a member of ``climate`` has.

    One pass slides over each (member, coarse cell)'s days and feeds all dates. ``dates`` is a calendar's months at most.
    """
    by = [*(members or []), *on]
    used = [w for w in windows if any(c.endswith(f"_{w}d") for c in columns)]
    asked = climate.select(*by).distinct().crossJoin(F.broadcast(dates.select("date")))
    return day_windows(asked, climate, by, variables, used, days)


def project(
    grid: DataFrame, climate: DataFrame | None, dates: DataFrame | None, on: list[str], key: list[str], variables: list[str], columns: list[str], draws,
    members: list[str] | None = None, windows=WINDOWS, days: int = 60, feats: DataFrame | None = None, spread: int = 16,
) -> DataFrame:
    """(key, members, date, mean and deviation of probability): every grid row on every date, for every member that ``climate`` has.

    Features are per coarse cell of ``on`` and only then meet the fine grid, where missing ones count as 0;
    ``feats`` are those of ``member_features``, if they are at hand. Every grid row becomes as many as members have dates, so
    the fine rows of a coarse cell are dealt by hash over ``spread`` parts, which each hold its features, and few
    coarse cells keep all cores busy.
    """
    if feats is None:
        feats = member_features(climate, dates, on, variables, columns, members, windows, days)
    session = grid.sparkSession
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    fine = grid.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(spread)).cast("int")).repartition(tasks, *on, "_part")
    coarse = feats.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(tasks, *on, "_part")
    ready = join_features(fine, coarse.hint("merge"), [*on, "_part"])
    return score(ready.na.fill(0.0, columns), columns, draws, [*key, *(members or []), "date"])


def zone_projection(pred: DataFrame, by: list[str]) -> DataFrame:
    """Mean, maximum and deviation over space, and mean uncertainty, of ``project`` per zone, month and ``by``."""
    p = "mean_probability"
    return pred.groupBy("zone_id", *by, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.avg(p).alias("mean_risk"), F.max(p).alias("max_risk"), F.stddev(p).alias("spatial_std"), F.avg("std_probability").alias("prediction_uncertainty"))


def write_members(df: DataFrame, members: DataFrame, path: str) -> list[str]:
    """Write ``df`` in a folder for each row of ``members`` (scenario, member, ...), skipping those that are whole; returns what it wrote.

    ``members`` are a few dozen names; each is one job, so a run that stops goes on where it was. Read
    back at ``path``, the names are columns again.
    """
    wrote, folder = [], df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in sorted(members.distinct().collect(), key=str):
        mine = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in row.asDict().items()))
        at = "/".join([path, *(folder(c, None if v is None else str(v)) for c, v in row.asDict().items())])
        if write_once(df.where(mine).drop(*members.columns), at):
            wrote.append(at)
    return wrote
