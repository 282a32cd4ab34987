"""Queries of look-back features, the model and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberframe.operators import grid as G
from emberframe.operators import lookback as W
from emberframe.operators import metrics as E
from emberframe.operators import model as M
from emberframe.plans.base import CELLS, CLIM, EV, PRED, SEASON, cells, climate, events, predictions, remove, rounded, shared_folder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# look-back windows

KEYS = "k AS (SELECT id_obs, site_id % 100 AS loc, date FROM ev)"
LB = f"{EV}, {KEYS}, {CLIM}, lb AS (SELECT k.id_obs, k.loc, k.date, i AS lag, c.T, c.P FROM k CROSS JOIN (SELECT CAST(range AS INT) AS i FROM range(60)) LEFT JOIN clim c ON c.loc = k.loc AND c.day = k.date - i)"

LB60 = f"{EV}, {KEYS}, {CLIM}, lb60 AS (SELECT k.id_obs, c.T FROM k LEFT JOIN clim c ON c.loc = k.loc AND c.day <= k.date AND c.day > k.date - 60)"


def long(spark, d, days=60):
    e = events(spark, d).select("id_obs", (F.col("site_id") % 100).alias("loc"), "date")
    return W.lookback(e, climate(spark, d), ["loc"], days)


def features(spark, d, variables, days=60, **how):
    e = events(spark, d).select("id_obs", (F.col("site_id") % 100).alias("loc"), "date")
    return W.day_windows(e, climate(spark, d), ["loc"], variables, W.WINDOWS, days, **how).drop("loc", "date")


@query(f"WITH {LB} SELECT id_obs, lag, round(T, 6) AS T FROM lb WHERE T IS NOT NULL")
def w01_lookback(spark, d):
    return rounded(long(spark, d).where("T is not null").select("id_obs", "lag", "T"))


WINS = (1, 3, 5, 10, 15, 30, 60)


@query(f"WITH {LB} SELECT id_obs, " + ", ".join(f"round(coalesce(sum(CASE WHEN lag < {w} THEN {v} END), 0) / {w}, 9) AS {v}_cumulative_mean_{w}d, round(max(CASE WHEN lag < {w} THEN {v} END), 9) AS {v}_cumulative_max_{w}d" for v in "TP" for w in WINS) + " FROM lb GROUP BY 1")
def w03_window_features(spark, d):
    return rounded(features(spark, d, ["T", "P"]), 9)


@query(f"WITH {LB} SELECT id_obs, " + ", ".join(f"round(avg(CASE WHEN lag >= {60 - w} THEN T END), 9) AS T_cumulative_mean_{w}d, round(max(CASE WHEN lag >= {60 - w} THEN T END), 9) AS T_cumulative_max_{w}d" for w in WINS) + " FROM lb GROUP BY 1")
def w04_window_features_oldest(spark, d):
    return rounded(features(spark, d, ["T"], anchor="oldest", missing="skip"), 9)


@query(f"WITH {LB} SELECT loc, lag, round(avg(T), 6) AS chip_mean FROM lb GROUP BY 1, 2")
def w02_chip_mean(spark, d):
    return rounded(W.chip_mean(long(spark, d), ["loc", "lag"], "T"))


GRID = "grid AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST((l_partkey * 7) % 200 AS BIGINT) AS ix, CAST((l_suppkey * 13) % 200 AS BIGINT) AS iy, avg(l_quantity) AS T, avg(l_discount) AS P FROM lineitem GROUP BY ALL), spots AS (SELECT id_obs, date, CAST(floor(x / 5) AS BIGINT) AS ix, CAST(floor(y / 5) AS BIGINT) AS iy FROM ev)"


def spots(spark, d):
    return G.to_cell(events(spark, d), 0, 0, 5, 200, 200).select("id_obs", "date", "ix", "iy")


def grid_days(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.to_date("l_shipdate").alias("day"), (F.col("l_partkey") * 7 % 200).alias("ix"), (F.col("l_suppkey") * 13 % 200).alias("iy")).agg(
        F.avg("l_quantity").alias("T"), F.avg("l_discount").alias("P"))


CHIPS = f"{EV}, {GRID}, m AS (SELECT id_obs, CAST(s.date - g.day AS INT) AS lag, avg(T) AS T, avg(P) AS P FROM spots s JOIN grid g ON g.day <= s.date AND g.day > s.date - 60 AND g.ix BETWEEN s.ix - 16 AND s.ix + 15 AND g.iy BETWEEN s.iy - 16 AND s.iy + 15 GROUP BY ALL)"


@query(f"WITH {CHIPS} SELECT id_obs, lag, round(T, 6) AS T, round(P, 6) AS P FROM m")
def w02_chip_series(spark, d):
    """Means of two variables over the 32 by 32 chip of every event on each of 60 days."""
    return rounded(W.chip_series(spots(spark, d).select("id_obs", "date", "ix", "iy"), grid_days(spark, d), ["T", "P"]).where("T is not null OR P is not null").select("id_obs", "lag", "T", "P"))


@query(f"WITH {CHIPS} SELECT s.id_obs, " + ", ".join(f"round(coalesce(sum(CASE WHEN lag < {w} THEN T END), 0) / {w}, 6) AS T_cumulative_mean_{w}d, round(max(CASE WHEN lag < {w} THEN T END), 6) AS T_cumulative_max_{w}d" for w in (1, 3, 5, 10, 15, 30, 60)) + " FROM spots s LEFT JOIN m ON m.id_obs = s.id_obs GROUP BY 1")
def w03_chip_features(spark, d):
    """Window features of the chips' series: what the model is trained on."""
    s = spots(spark, d)
    return rounded(W.day_windows(s, W.chip_means(s, grid_days(spark, d), ["T"]), ["ix", "iy"], ["T"]).drop("date", "ix", "iy"))


@query(f"WITH {CELLS}, c AS (SELECT ix // 4 AS bx, iy // 4 AS \"by\", code % 4 AS m FROM cells), n AS (SELECT bx, \"by\", m, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bx, \"by\" ORDER BY n DESC, m) AS rn FROM n) SELECT bx, \"by\", m AS chip_mode FROM r WHERE rn = 1")
def w07_chip_mode(spark, d):
    c = cells(spark, d).select(F.expr("ix div 4").cast("int").alias("bx"), F.expr("iy div 4").cast("int").alias("by"), (F.col("code") % 4).alias("m"))
    return W.chip_mode(c, ["bx", "by"], "m")


@query(f"WITH {LB}, s AS (SELECT id_obs, lag, 'loc' AS channel, CAST(loc AS DOUBLE) AS value FROM lb UNION ALL SELECT id_obs, lag, 'T', T FROM lb) SELECT channel, lag, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY 1, 2")
def w08_time_channel_long(spark, d):
    lb = long(spark, d)
    static = events(spark, d).select("id_obs", (F.col("site_id") % 100).cast("double").alias("loc"))
    return rounded(W.time_channel_long(static, lb, "id_obs", ["T"], 60).groupBy("channel", "lag").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 3)


@query(f"WITH {LB} SELECT id_obs, count(T) AS n_days FROM lb GROUP BY 1 HAVING count(T) < 60")
def w09_lookback_coverage(spark, d):
    return W.lookback_coverage(long(spark, d), ["id_obs"], "T", 60)


@query("WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT user_id FROM events) SELECT k.user_id, " + ", ".join(f"round(coalesce(sum(CASE WHEN day > DATE '2024-01-30' - {w} THEN v END), 0) / {w}, 6) AS v_cumulative_mean_{w}d, round(max(CASE WHEN day > DATE '2024-01-30' - {w} THEN v END), 6) AS v_cumulative_max_{w}d" for w in (1, 3, 5, 10, 15, 30)) + " FROM k LEFT JOIN u ON u.user_id = k.user_id AND day > DATE '2023-12-31' AND day <= DATE '2024-01-30' GROUP BY 1")
def w05_short_history(spark, d):
    ev = table(spark, d, "events")
    series = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    keys = ev.select("user_id").distinct().withColumn("date", F.lit("2024-01-30").cast("date"))
    return rounded(W.day_windows(keys, series, ["user_id"], ["v"], W.WINDOWS, 30).drop("date"))


@query(f"WITH {LB60}, {CELLS}, a AS (SELECT id_obs, coalesce(sum(T), 0) / 60 AS m, max(T) AS t FROM lb60 GROUP BY 1), b AS (SELECT id_obs, c.v FROM ev JOIN cells c ON c.ix = CAST(floor(ev.x / 10) AS INT) AND c.iy = CAST(floor(ev.y / 10) AS INT)) SELECT id_obs, round(m, 9) AS T_cumulative_mean_60d, round(t, 9) AS T_cumulative_max_60d, round(v, 9) AS v FROM a JOIN b USING (id_obs)")
def w10_join_features(spark, d):
    static = G.sample_at(G.to_cell(events(spark, d), 0.0, 0.0, 10.0, 100, 100), cells(spark, d).select("ix", "iy", "v")).where("v is not null").select("id_obs", "v")
    dynamic = features(spark, d, ["T"], 60).select("id_obs", "T_cumulative_mean_60d", "T_cumulative_max_60d")
    return rounded(W.join_features(dynamic, static, ["id_obs"]), 9)


# model

COLS = ["l_quantity", "l_discount", "l_tax"]
DRAWS = [(-1.0, [0.02, 3.0, -2.0], [1.0, 0.5, 0.5]), (-0.8, [0.03, 2.0, -1.0], [0.8, 0.7, 0.5]), (-1.2, [0.01, 4.0, 1.0], [0.6, 0.6, 0.8]), (-1.1, [0.025, 1.0, 0.5], [1.0, 0.2, 0.8])]
FLAT = [(a, [x * y for x, y in zip(b, t)]) for a, b, t in DRAWS]
SCORED = "sc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, [" + ", ".join(
    f"1 / (1 + exp(-({a}::DOUBLE + l_quantity * {w[0]!r}::DOUBLE + l_discount * {w[1]!r}::DOUBLE + l_tax * {w[2]!r}::DOUBLE)))" for a, w in FLAT) + "] AS p FROM lineitem)"
KEEP = ["l_orderkey", "l_linenumber", "l_partkey"]
MEAN, STD = [25.0, 0.05, 0.04], [15.0, 0.03, 0.02]
SCALED_SQL = "WITH sc AS (SELECT l_orderkey, l_linenumber, l_partkey, [" + ", ".join(
    f"1 / (1 + exp(-({a}::DOUBLE" + "".join(f" + 0.5 * {b}::DOUBLE * {t} * ({c} - {m}) / {s}" for b, t, c, m, s in zip(beta, tau, COLS, MEAN, STD)) + ")))"
    for a, beta, tau in DRAWS) + "] AS p FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(list_avg(p), 6) AS mean_probability, round(list_stddev_pop(p), 6) AS std_probability FROM sc"


@query("SELECT feature, round(m, 6) AS mean, round(s, 6) AS std FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem" for c in COLS) + ")")
def m01_fit_scaler(spark, d):
    return rounded(M.fit_scaler(table(spark, d, "lineitem"), COLS))


@query("SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}" for c in COLS) + " FROM lineitem")
def m01_apply_scaler(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(M.apply_scaler(li, M.fit_scaler(li, COLS), COLS).select(*KEEP, *COLS))


@query("SELECT l_returnflag, feature, round(m, 6) AS mean, round(s, 6) AS std FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS feature, avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem GROUP BY 1" for c in COLS) + ")")
def m02_scaler_by_group(spark, d):
    return rounded(M.fit_scaler(table(spark, d, "lineitem"), COLS, ["l_returnflag"]))


@query("SELECT p_type, CASE WHEN lower(p_type) LIKE '%tri%' THEN 'static_topo' ELSE 'static_other' END AS grp, count(*) AS n FROM part GROUP BY 1, 2")
def m03_feature_groups(spark, d):
    p = table(spark, d, "part")
    names = [r.p_type for r in p.select("p_type").distinct().collect()]  # the feature names: a handful of types
    groups = M.feature_groups(names, {})
    grp = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
    return p.groupBy("p_type", F.try_element_at(grp, F.col("p_type")).alias("grp")).agg(F.count("*").alias("n"))


SCORE_SQL = f"WITH {SCORED} SELECT l_orderkey, l_linenumber, l_partkey, round(list_avg(p), 6) AS mean_probability, round(list_stddev_pop(p), 6) AS std_probability FROM sc"


@query(SCORE_SQL)
def m05_score(spark, d):
    return rounded(M.score(table(spark, d, "lineitem"), COLS, FLAT, KEEP))


@query(SCALED_SQL)
def m05_score_use_scale(spark, d):
    """Attention times its fitted scale, as in the likelihood."""
    draws = [M.fold_draw(a, b, t, MEAN, STD, 0.5, use_scale=True) for a, b, t in DRAWS]
    return rounded(M.score(table(spark, d, "lineitem"), COLS, draws, KEEP))


@query(SCORE_SQL)
def m05_score_many(spark, d):
    return rounded(M.score_many(table(spark, d, "lineitem"), COLS, FLAT, KEEP))


@query(f"WITH {LB}, w AS (SELECT * FROM (VALUES (0, 'T', 0.02::DOUBLE), (0, 'P', -0.01), (1, 'T', 0.03), (1, 'P', 0.01)) t(draw, channel, beta)), a AS (SELECT d AS draw, l AS lag, 1.0::DOUBLE / (l + 1 + d) AS tau FROM range(2) x(d), range(5) y(l)), l AS (SELECT id_obs, lag, 'T' AS channel, T AS value FROM lb WHERE lag < 5 AND T IS NOT NULL UNION ALL SELECT id_obs, lag, 'P', P FROM lb WHERE lag < 5 AND P IS NOT NULL), z AS (SELECT id_obs, w.draw, sum(value * beta * tau) AS z FROM l JOIN w ON l.channel = w.channel JOIN a ON a.draw = w.draw AND a.lag = l.lag GROUP BY 1, 2) SELECT id_obs, round(avg(1 / (1 + exp(-(z + -1.0 - 0.5 * draw)))), 6) AS mean_probability FROM z GROUP BY 1")
def m06_score_timeseries(spark, d):
    lb = long(spark, d, 5).unpivot(["id_obs", "lag"], ["T", "P"], "channel", "value").where("value is not null")
    weights = spark.createDataFrame([(0, "T", 0.02), (0, "P", -0.01), (1, "T", 0.03), (1, "P", 0.01)], "draw int, channel string, beta double")
    attention = spark.createDataFrame([(k, i, 1.0 / (i + 1 + k)) for k in range(2) for i in range(5)], "draw int, lag int, tau double")
    alphas = spark.createDataFrame([(0, -1.0), (1, -1.5)], "draw int, alpha double")
    return rounded(M.score_timeseries(lb, weights, attention, alphas, "id_obs"))


@query(f"WITH {SCORED}, m AS (SELECT *, list_avg(p) AS mp FROM sc) SELECT l_orderkey, l_linenumber, l_partkey, round(mp, 6) AS outcome_mean, round(sqrt(mp * (1 - mp)), 6) AS outcome_std FROM m")
def m07_bernoulli_summary(spark, d):
    return rounded(M.bernoulli_summary(M.score(table(spark, d, "lineitem"), COLS, FLAT, KEEP), KEEP))


ATT = "att AS (SELECT l_linenumber AS draw, l_returnflag || l_linestatus AS grp, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)"


def attention(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("draw"), F.concat("l_returnflag", "l_linestatus").alias("grp")).agg(F.sum("l_quantity").alias("weight"))


@query(f"WITH {ATT}, m AS (SELECT grp, avg(weight) AS mean_attention FROM att GROUP BY 1) SELECT grp, round(mean_attention, 6) AS mean_attention, CAST(rank() OVER (ORDER BY mean_attention DESC) AS INT) AS rnk FROM m")
def m08_attention_ranking(spark, d):
    return rounded(M.attention_ranking(attention(spark, d)))


@query(f"WITH {ATT}, t AS (SELECT draw, arg_max(grp, weight) AS grp FROM att GROUP BY 1) SELECT grp, count(*) AS n_draws, round((SELECT 1 / (1 + exp(-avg(-0.1 * l_linenumber::DOUBLE))) FROM (SELECT DISTINCT l_linenumber FROM lineitem)), 6) AS baseline_probability FROM t GROUP BY 1")
def m09_draw_diagnostics(spark, d):
    alphas = table(spark, d, "lineitem").select("l_linenumber").distinct().select((F.col("l_linenumber") * F.lit(-0.1)).alias("alpha"))
    return rounded(M.draw_diagnostics(attention(spark, d), alphas))


@query(f"WITH {SCORED}, m AS (SELECT list_avg(p) AS mp, list_stddev_pop(p) AS sp FROM sc) SELECT round(avg(mp), 6) AS mean_p, round(quantile_cont(mp, 0.5), 6) AS median_p, round(min(mp), 6) AS min_p, round(max(mp), 6) AS max_p, round(avg(sp), 6) AS mean_std, count(CASE WHEN sp > 0.15 THEN 1 END) AS n_uncertain FROM m")
def m10_prediction_summary(spark, d):
    return rounded(M.prediction_summary(M.score(table(spark, d, "lineitem"), COLS, FLAT, KEEP)))


@query()
def m04_fit_draws(spark, d):
    """Bootstrap draws of a penalised fit: no SQL form; tests check that they separate the classes."""
    from emberframe.operators.sampling import train_test_split

    p = train_test_split(predictions(spark, d), "label", 0.3, 1, "doc_id")
    draws = M.fit_draws(p.where(~F.col("is_test")), ["score", "score2"], "label", {"score": 3.0, "score2": 1.5}, 3, "doc_id")
    return M.score(p.where("is_test"), ["score", "score2"], draws, ["doc_id", "label"])


# Newton's method on the same loss, in plain SQL: the gradient and curvature of three coefficients, solved by Cramer's rule.
MODE = f"""WITH RECURSIVE {PRED}, d AS (SELECT label AS y, score AS a, score2 AS b FROM pred),
 it(k, w0, w1, w2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, w0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
   w1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
   w2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
   SELECT k, w0, w1, w2, sum(p - y) + w0 / 4 AS g0, sum((p - y) * a) + w1 / 9 AS g1, sum((p - y) * b) + w2 / 2.25 AS g2,
    sum(q) + 0.25 AS h00, sum(q * a) AS h01, sum(q * b) AS h02, sum(q * a * a) + 1 / 9.0::DOUBLE AS h11, sum(q * a * b) AS h12, sum(q * b * b) + 1 / 2.25::DOUBLE AS h22
   FROM (SELECT *, p * (1 - p) AS q FROM (SELECT it.*, d.*, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS p FROM it, d WHERE k < 20)) GROUP BY k, w0, w1, w2)))
 SELECT u.term, round(u.value, 6) AS value FROM it, LATERAL (SELECT unnest(['alpha', 'score', 'score2']) AS term, unnest([w0, w1, w2]) AS value) u WHERE k = 20"""


@query(MODE)
def m04_fit_mode(spark, d):
    """Coefficients at the mode, without a bootstrap."""
    names = ["score", "score2"]
    alpha, beta = M.fit_draws(predictions(spark, d), names, "label", {"score": 3.0, "score2": 1.5}, 1, "doc_id", bootstrap=False)[0]
    return rounded(spark.createDataFrame(list(zip(["alpha", *names], [alpha, *beta])), "term string, value double"))


SPAN = "['1d', 'short', 'short', 'medium', 'medium', '30d', '60d'][1 + p_partkey % 7]"


@query(f"WITH n AS (SELECT ['T_cumulative_mean_', 'P_cumulative_max_', 'slope_', 'landcover_'][1 + p_size % 4] || [1, 3, 5, 10, 15, 30, 60][1 + p_partkey % 7] || 'd' AS name, CASE p_size % 4 WHEN 0 THEN 'temp_' || {SPAN} WHEN 1 THEN 'precip_' || {SPAN} WHEN 2 THEN 'static_topo' ELSE 'static_veg' END AS grp FROM part) SELECT name, grp, count(*) AS n FROM n GROUP BY 1, 2")
def m03_feature_families(spark, d):
    """Features of temperature, rain and two static families, named in the data."""
    at = lambda items, i: F.get(F.array(*map(F.lit, items)), i.cast("int"))
    name = F.concat(
        at(["T_cumulative_mean_", "P_cumulative_max_", "slope_", "landcover_"], F.col("p_size") % 4), at([1, 3, 5, 10, 15, 30, 60], F.col("p_partkey") % 7).cast("string"), F.lit("d"))
    p = table(spark, d, "part").select(name.alias("name"))
    groups = M.feature_groups([r.name for r in p.distinct().collect()])  # 28 names
    grp = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
    return p.groupBy("name", F.try_element_at(grp, F.col("name")).alias("grp")).agg(F.count("*").alias("n"))


PROJ_W = [(-1.0, [0.02, 0.01, 0.03, 0.01]), (-0.5, [0.01, 0.015, 0.02, -0.01])]
PROJ_COLS = ["T_cumulative_mean_30d", "T_cumulative_max_60d", "P_cumulative_mean_60d", "v"]
MEMBERS = ["scenario", "member"]
PROJ = """cm AS (SELECT l_returnflag AS scenario, l_suppkey % 3 AS member, l_partkey % 20 AS loc, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS T, avg(l_extendedprice) / 1000 AS P FROM lineitem GROUP BY ALL),
 dates AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) + 14 AS date FROM cm), k AS (SELECT * FROM (SELECT DISTINCT scenario, member, loc FROM cm), dates),
 f AS (SELECT k.scenario, k.member, k.loc, k.date, coalesce(sum(CASE WHEN k.date - c.day < 30 THEN T END), 0) / 30 AS a, coalesce(max(T), 0) AS b, coalesce(sum(P), 0) / 60 AS c
  FROM k LEFT JOIN cm c ON c.scenario = k.scenario AND c.member = k.member AND c.loc = k.loc AND c.day <= k.date AND c.day > k.date - 60 GROUP BY ALL),
 g AS (SELECT p_partkey AS cell_id, p_partkey % 20 AS loc, p_retailprice / 1000 AS v, CAST(p_size % 10 AS INT) AS zone_id FROM part),
 s AS (SELECT cell_id, zone_id, scenario, member, date, [""" + ", ".join(
    f"1 / (1 + exp(-({a}::DOUBLE + a * {w[0]}::DOUBLE + b * {w[1]}::DOUBLE + c * {w[2]}::DOUBLE + v * {w[3]}::DOUBLE)))" for a, w in PROJ_W) + "] AS p FROM g JOIN f ON g.loc = f.loc)"


def member_climate(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("scenario"), (F.col("l_suppkey") % 3).alias("member"), (F.col("l_partkey") % 20).alias("loc"), F.to_date("l_shipdate").alias("day")).agg(
        F.avg("l_quantity").alias("T"), (F.avg("l_extendedprice") / 1000).alias("P"))


def projected_features(spark, d):
    c = member_climate(spark, d)
    return M.member_features(c, M.projection_dates(c), ["loc"], ["T", "P"], PROJ_COLS, MEMBERS)


def projected(spark, d, feats):
    grid = table(spark, d, "part").select(
        F.col("p_partkey").alias("cell_id"), (F.col("p_partkey") % 20).alias("loc"), (F.col("p_retailprice") / 1000).alias("v"), (F.col("p_size") % 10).cast("int").alias("zone_id"))
    return M.project(grid, None, None, ["loc"], ["cell_id", "zone_id"], ["T", "P"], PROJ_COLS, PROJ_W, MEMBERS, feats=feats)


@query(f"WITH {PROJ} SELECT zone_id, scenario, member, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, round(avg(list_avg(p)), 6) AS mean_risk, round(max(list_avg(p)), 6) AS max_risk, round(stddev_samp(list_avg(p)), 6) AS spatial_std, round(avg(list_stddev_pop(p)), 6) AS prediction_uncertainty FROM s GROUP BY ALL")
def m11_projection(spark, d):
    """Zones by month over all members, years and months that the data have; look-backs of 60 days."""
    return rounded(M.zone_projection(projected(spark, d, projected_features(spark, d)), MEMBERS))


@query(f"WITH {PROJ} SELECT scenario, CAST(member AS INT) AS member, date, count(*) AS n_cells, round(sum(list_avg(p)), 4) AS total FROM s GROUP BY ALL")
def m11_projection_files(spark, d):
    """The same by cell, in a folder a member; one loses its mark of success, as if the job had died, and is made again alone."""
    path, at = shared_folder(spark, "projection"), shared_folder(spark, "features")
    projected_features(spark, d).write.parquet(at)  # once for all members
    feats = spark.read.parquet(at)
    pred, names = projected(spark, d, feats), feats.select(*MEMBERS).distinct()
    first = M.write_members(pred, names, path)
    remove(spark, f"{first[0]}/_SUCCESS")
    if M.write_members(pred, names, path) != first[:1]:
        raise RuntimeError("a whole member was written again")
    read = spark.read.parquet(path).groupBy("scenario", "member", "date").agg(F.count("*").alias("n_cells"), F.sum("mean_probability").alias("total"))
    return rounded(read, 4)


# validation


@query(f"WITH {PRED} SELECT CAST(month(date) AS INT) AS period, sum(label)::BIGINT AS observed, round(sum(score), 6) AS expected FROM pred GROUP BY 1")
def e01_count_by_month(spark, d):
    return rounded(E.count_by_period(predictions(spark, d), "month"))


@query(f"WITH {PRED}, g AS (SELECT {SEASON.format('month(date)')} AS period, sum(label)::BIGINT AS observed, sum(score) AS expected FROM pred GROUP BY 1) SELECT s.period, coalesce(observed, 0) AS observed, round(coalesce(expected, 0), 6) AS expected FROM (VALUES ('Winter'), ('Spring'), ('Summer'), ('Fall')) s(period) LEFT JOIN g ON g.period = s.period")
def e01_count_by_season(spark, d):
    return rounded(E.count_by_period(predictions(spark, d), "season"))


@query(f"WITH {PRED} SELECT round(corr(score, score2), 6) AS r, NULL::DOUBLE AS r_constant FROM pred")
def e02_pearson(spark, d):
    return rounded(predictions(spark, d).withColumn("one", F.lit(1.0)).agg(E.pearson("score", "score2").alias("r"), E.pearson("score", "one").alias("r_constant")))


@query(f"WITH {PRED}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY score2) + (count(*) OVER (PARTITION BY score2) - 1) / 2.0 AS b FROM pred) SELECT round(corr(a, b), 6) AS rho, round(corr(a, b) * corr(a, b), 6) AS rho_sq FROM r")
def e03_spearman(spark, d):
    return rounded(E.spearman(predictions(spark, d), "score", "score2"))


MON = "m AS (SELECT month(date) AS period, sum(label) AS o, sum(score) AS e FROM pred GROUP BY 1)"


@query(f"WITH {PRED}, {MON} SELECT round(1 - sum((o - e) * (o - e)) / (var_pop(o) * count(o)), 6) AS r2, round(sqrt(avg((o - e) * (o - e))), 6) AS rmse, round(avg(abs(o - e)), 6) AS mae FROM m")
def e04_fit_errors(spark, d):
    return rounded(E.fit_errors(E.count_by_period(predictions(spark, d), "month"), "observed", "expected"))


@query(f"WITH {PRED}, {MON}, k AS (SELECT sum(o) / sum(e) AS f FROM m), n AS (SELECT o, e, e * f AS s, f FROM m, k) SELECT round(max(f), 6) AS scale, round(1 - sum((o - e) * (o - e)) / (var_pop(o) * count(o)), 6) AS r2, round(sqrt(avg((o - e) * (o - e))), 6) AS rmse, round(avg(abs(o - e)), 6) AS mae, round(1 - sum((o - s) * (o - s)) / (var_pop(o) * count(o)), 6) AS r2_scaled, round(sqrt(avg((o - s) * (o - s))), 6) AS rmse_scaled, round(avg(abs(o - s)), 6) AS mae_scaled, round(sqrt(avg((o - s) * (o - s))) - sqrt(avg((o - e) * (o - e))), 6) AS rmse_change FROM n")
def e06_scale_analysis(spark, d):
    return rounded(E.scale_analysis(E.count_by_period(predictions(spark, d), "month"), "observed", "expected"))


CUM = "b AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM pred GROUP BY 1), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM b)"
PRC = "pr AS (SELECT score, tp / CAST(tp + fp AS DOUBLE) AS pre, tp / CAST(pos AS DOUBLE) AS rec FROM c)"


@query(f"WITH {PRED}, {CUM} SELECT round(score, 9) AS score, round(fp / CAST(neg AS DOUBLE), 9) AS fpr, round(tp / CAST(pos AS DOUBLE), 9) AS tpr FROM c")
def e07_roc_curve(spark, d):
    return rounded(E.roc_curve(predictions(spark, d)), 9)


@query(f"WITH {PRED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM pred) SELECT round((sum(CASE WHEN label = 1 THEN k END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r")
def e08_roc_auc(spark, d):
    return rounded(E.roc_auc(predictions(spark, d)))


@query(f"WITH {PRED}, {CUM}, {PRC} SELECT round(sum((rec - coalesce(prev, 0)) * pre), 6) AS ap FROM (SELECT *, lag(rec) OVER (ORDER BY score DESC) AS prev FROM pr)")
def e09_average_precision(spark, d):
    return rounded(E.average_precision(predictions(spark, d)))


@query(f"WITH {PRED}, {CUM} SELECT round(score, 9) AS score, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(pos AS DOUBLE), 9) AS recall, round(p / CAST(pos AS DOUBLE), 9) AS gain FROM (SELECT c.*, b.p FROM c JOIN b ON b.score = c.score)")
def e09_pr_curve(spark, d):
    return rounded(E.pr_curve(predictions(spark, d)), 9)


@query(f"WITH {PRED}, {CUM}, {PRC}, f AS (SELECT score, coalesce(2 * pre * rec / nullif(pre + rec, 0), 0) AS f1 FROM pr) SELECT round(f1, 6) AS f1, round(score, 6) AS threshold FROM f ORDER BY f.f1 DESC, f.score DESC LIMIT 1")
def e10_max_f1(spark, d):
    return rounded(E.max_f1(predictions(spark, d)))


@query(f"WITH {PRED}, t AS (SELECT max(score) AS top FROM pred), g AS (SELECT CAST(least(floor(score / top * 10), 9) AS INT) AS bin, avg(label) AS y, avg(score) AS p, count(*) AS n FROM pred, t GROUP BY 1) SELECT CAST(i AS INT) AS bin, round(coalesce(y, (i + 0.5) * top / 10), 6) AS mean_label, round(coalesce(p, (i + 0.5) * top / 10), 6) AS mean_score, coalesce(n, 0) AS n FROM range(10) r(i) CROSS JOIN t LEFT JOIN g ON g.bin = i")
def e11_calibration(spark, d):
    return rounded(E.calibration(predictions(spark, d)))


@query(f"WITH {PRED}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM pred), t AS (SELECT count(*) AS a, sum(label) AS p FROM pred) SELECT CAST(i AS INT) AS percent, CAST(floor(a * i / 100.0) AS BIGINT) AS n, round(sum(CASE WHEN k <= floor(a * i / 100.0) THEN label ELSE 0 END) / nullif(floor(a * i / 100.0), 0) / (p / CAST(a AS DOUBLE)), 6) AS lift, round(CASE WHEN floor(a * i / 100.0) > 0 THEN sum(CASE WHEN k <= floor(a * i / 100.0) THEN label ELSE 0 END) / CAST(p AS DOUBLE) END, 6) AS captured FROM range(1, 101) x(i), r, t GROUP BY i, a, p")
def e12_lift_curve(spark, d):
    return rounded(E.lift_curve(predictions(spark, d), "doc_id", list(range(1, 101))))


@query(f"WITH {PRED} SELECT round(avg(label), 6) AS prevalence, round((count(*) - sum(label)) / CAST(sum(label) AS DOUBLE), 6) AS negatives_per_positive FROM pred")
def e13_class_balance(spark, d):
    return rounded(E.class_balance(predictions(spark, d)))


def pair(spark, d):
    p = predictions(spark, d)
    a = p.where("doc_id % 2 = 0 AND date >= DATE'2020-06-01'")
    b = p.where("doc_id % 2 = 1 AND date <= DATE'2023-06-01'").withColumn("score", F.col("score2"))
    return E.overlap_period(a, b)


PAIR = "a0 AS (SELECT * FROM pred WHERE doc_id % 2 = 0 AND date >= DATE '2020-06-01'), b0 AS (SELECT doc_id, label, score2 AS score, date FROM pred WHERE doc_id % 2 = 1 AND date <= DATE '2023-06-01'), lim AS (SELECT greatest((SELECT min(date) FROM a0), (SELECT min(date) FROM b0)) AS lo, least((SELECT max(date) FROM a0), (SELECT max(date) FROM b0)) AS hi), am AS (SELECT a0.* FROM a0, lim WHERE date BETWEEN lo AND hi), bm AS (SELECT b0.* FROM b0, lim WHERE date BETWEEN lo AND hi)"


@query(f"WITH {PRED}, {PAIR} SELECT 'a' AS model, count(*) AS n, min(date) AS lo, max(date) AS hi FROM am UNION ALL SELECT 'b', count(*), min(date), max(date) FROM bm")
def e14_overlap_period(spark, d):
    a, b = pair(spark, d)
    agg = lambda x, n: x.agg(F.lit(n).alias("model"), F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    return agg(a, "a").unionByName(agg(b, "b"))


COMMON = "a0 AS (SELECT * FROM pred WHERE date >= DATE '2020-06-01' AND doc_id % 3 < 2), b0 AS (SELECT * FROM pred WHERE date <= DATE '2023-06-01' AND doc_id % 3 > 0), lim AS (SELECT greatest((SELECT min(date) FROM a0), (SELECT min(date) FROM b0)) AS lo, least((SELECT max(date) FROM a0), (SELECT max(date) FROM b0)) AS hi)"


@query(f"WITH {PRED}, {COMMON} SELECT a0.doc_id, a0.label, round(a0.score, 9) AS a_score, round(b0.score2, 9) AS b_score FROM a0 JOIN b0 ON a0.doc_id = b0.doc_id, lim WHERE a0.date BETWEEN lo AND hi AND b0.date BETWEEN lo AND hi")
def e14_on_common_ids(spark, d):
    """Two models tested on overlapping rows, compared on those that both have."""
    p = predictions(spark, d)
    a, b = E.overlap_period(p.where("date >= DATE'2020-06-01' AND doc_id % 3 < 2"), p.where("date <= DATE'2023-06-01' AND doc_id % 3 > 0"), "doc_id")
    both = a.select("doc_id", "label", F.col("score").alias("a_score")).join(b.select("doc_id", F.col("score2").alias("b_score")), "doc_id")
    return rounded(both, 9)


def metric_rows(spark, d):
    out = None
    for name, x in zip("ab", pair(spark, d)):
        for metric, df in (("auc", E.roc_auc(x)), ("ap", E.average_precision(x))):
            row = df.select(F.lit(name).alias("model"), F.lit(metric).alias("metric"), F.col(metric).alias("value"))
            out = row if out is None else out.unionByName(row)
    return out


def _auc(t):
    return f"(SELECT (sum(CASE WHEN label = 1 THEN k END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM {t}))"


def _ap(t):
    return f"(SELECT sum((rec - coalesce(prev, 0)) * pre) FROM (SELECT *, lag(rec) OVER (ORDER BY score DESC) AS prev FROM (SELECT score, tp / CAST(tp + fp AS DOUBLE) AS pre, tp / CAST(pos AS DOUBLE) AS rec FROM (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos FROM (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM {t} GROUP BY 1)))))"


CMP = f"cmp AS (SELECT 'auc' AS metric, CAST({_auc('am')} AS DOUBLE) AS x, CAST({_auc('bm')} AS DOUBLE) AS y UNION ALL SELECT 'ap', {_ap('am')}, {_ap('bm')})"


@query(f"WITH {PRED}, {PAIR}, {CMP} SELECT metric, round(x, 6) AS base_value, round(y, 6) AS other_value, round(y - x, 6) AS improvement, round((y - x) / x * 100, 5) AS pct_change FROM cmp")
def e15_compare_models(spark, d):
    c = E.compare_models(metric_rows(spark, d), "a", "b")
    return rounded(c.withColumn("pct_change", F.round("pct_change", 5)))


@query(f"WITH {PRED}, {PAIR}, {CMP}, m AS (SELECT avg((y - x) / x * 100) AS c FROM cmp) SELECT round(c, 5) AS mean_change, CASE WHEN c > 5 THEN 'use' WHEN c > 1 THEN 'marginal' ELSE 'no' END AS verdict FROM m")
def e16_recommend(spark, d):
    return rounded(E.recommend(E.compare_models(metric_rows(spark, d), "a", "b")), 5)


@query(f"WITH {PRED}, {MON} SELECT round(regr_slope(o, e), 6) AS slope, round(regr_intercept(o, e), 6) AS intercept FROM m")
def e17_linear_fit(spark, d):
    return rounded(E.linear_fit(E.count_by_period(predictions(spark, d), "month"), "expected", "observed"))


@query(f"WITH {PRED}, f AS (SELECT doc_id % 12 AS fold, CASE WHEN doc_id % 12 = 5 THEN NULL ELSE avg(score) END AS v FROM pred GROUP BY 1) SELECT count(*) AS n_folds, count(v) AS n_valid, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM f")
def e18_cv_summary(spark, d):
    f = predictions(spark, d).groupBy((F.col("doc_id") % 12).alias("fold")).agg(F.avg("score").alias("v"))
    return rounded(E.cv_summary(f.withColumn("v", F.when(F.col("fold") == 5, F.lit(float("nan"))).otherwise(F.col("v"))), "v"))


FOLDS = f"""q AS (SELECT doc_id % 3 AS fold, score, sum(label) AS p, count(*) - sum(label) AS n FROM pred GROUP BY 1, 2),
 r AS (SELECT fold, sum(n) OVER w / CAST(sum(n) OVER f AS DOUBLE) AS fpr, sum(p) OVER w / CAST(sum(p) OVER f AS DOUBLE) AS tpr FROM q WINDOW w AS (PARTITION BY fold ORDER BY score DESC), f AS (PARTITION BY fold)),
 s AS (SELECT fold, fpr, max(tpr) AS tpr FROM (SELECT * FROM r UNION ALL SELECT DISTINCT fold, 0.0::DOUBLE, 0.0::DOUBLE FROM r) GROUP BY 1, 2),
 e AS (SELECT *, lead(fpr) OVER (PARTITION BY fold ORDER BY fpr) AS f2, lead(tpr) OVER (PARTITION BY fold ORDER BY fpr) AS t2 FROM s),
 y AS (SELECT fold, g, arg_max(tpr + (t2 - tpr) * (g / 99.0::DOUBLE - fpr) / (f2 - fpr), fpr) AS v FROM e, (SELECT CAST(range AS INT) AS g FROM range(100)) WHERE f2 IS NOT NULL AND round(fpr * 99, 9) <= g AND round(f2 * 99, 9) >= g GROUP BY 1, 2)"""


@query(f"WITH {PRED}, {FOLDS} SELECT g AS grid, round(avg(v), 6) AS mean_tpr, round(stddev_pop(v), 6) AS std_tpr FROM y GROUP BY 1")
def e19_roc_band(spark, d):
    """Interpolated fold curves."""
    p, out = predictions(spark, d), None
    for k in range(3):
        c = E.roc_curve(p.where(F.col("doc_id") % 3 == k)).select(F.lit(k).alias("fold"), "fpr", "tpr")
        out = c if out is None else out.unionByName(c)
    return rounded(E.roc_band(out))


@query(f"WITH {EV}, s AS (SELECT count(*) AS n, date_diff('day', min(date), max(date)) + 1 AS k FROM ev) SELECT n AS n_events, CAST(k AS INT) AS n_days, round(n / (k / 365.25::DOUBLE), 6) AS per_year, round(n / CAST(k AS DOUBLE), 6) AS per_day, round(n / (k / 365.25::DOUBLE) / 7400 * 100, 6) AS per_100_area_year, round(n / CAST(k AS DOUBLE) / 400, 6) AS per_cell_day FROM s")
def e20_event_rates(spark, d):
    return rounded(E.event_rates(events(spark, d), 7400.0, 400))


@query(f"WITH {PRED} SELECT doc_id, round(score / (SELECT avg(score) FROM pred WHERE doc_id % 2 = 0), 6) AS relative_risk FROM pred")
def e21_relative_risk(spark, d):
    p = predictions(spark, d)
    return rounded(E.relative_risk(p, p.where("doc_id % 2 = 0")).select("doc_id", "relative_risk"))


@query(f"WITH {PRED} SELECT CAST(date_trunc('week', date) AS DATE) AS start, round(sum(score), 6) AS expected, count(*) AS n FROM pred GROUP BY 1")
def e22_expected_events(spark, d):
    return rounded(E.expected_events(predictions(spark, d)))


@query(f"WITH {PRED}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM pred), t AS (SELECT count(*) AS a, sum(label) AS p FROM pred) SELECT CAST(i AS INT) AS percent, round(sum(CASE WHEN k <= floor(a * i / 100.0) THEN label ELSE 0 END) / CAST(p AS DOUBLE), 6) AS captured FROM (VALUES (5), (10), (20), (50)) x(i), r, t GROUP BY i, p")
def e23_capture_rate(spark, d):
    return rounded(E.lift_curve(predictions(spark, d), "doc_id", [5, 10, 20, 50]).select("percent", "captured"))


RATE = "r AS (SELECT doc_id % 3 AS scenario, sum(score) / ((date_diff('day', min(date), max(date)) + 1) / 365.25::DOUBLE) AS rate FROM pred GROUP BY 1)"


@query(f"WITH {PRED}, {RATE} SELECT scenario, round(rate, 6) AS rate, round((rate - (SELECT rate FROM r WHERE scenario = 0)) / (SELECT rate FROM r WHERE scenario = 0) * 100, 5) AS change_percent FROM r")
def e24_scenario_change(spark, d):
    p = predictions(spark, d).withColumn("scenario", F.col("doc_id") % 3)
    c = E.scenario_change(E.period_rate(p, ["scenario"]), "scenario", 0)
    return rounded(c.withColumn("change_percent", F.round("change_percent", 5)))


@query(f"WITH {PRED}, d AS (SELECT doc_id % 100 AS draw, score FROM pred), t AS (SELECT draw // 10 AS block, sum(score) / count(DISTINCT draw) AS total FROM d GROUP BY 1) SELECT round(avg(total), 6) AS mean_total, round(quantile_cont(total, 0.025), 6) AS low, round(quantile_cont(total, 0.975), 6) AS high FROM t")
def e25_credible_interval(spark, d):
    return rounded(E.credible_interval(predictions(spark, d).select((F.col("doc_id") % 100).alias("draw"), "score")))


@query(f"WITH {PRED} SELECT doc_id % 7 AS region, round(avg(score), 6) AS mean_probability, round(sum(score * 365), 4) AS yearly_expected FROM pred GROUP BY 1")
def e26_regional_summary(spark, d):
    r = E.regional_summary(predictions(spark, d).withColumn("region", F.col("doc_id") % 7), "region")
    return rounded(r.withColumn("yearly_expected", F.round("yearly_expected", 4)))
