"""Queries of sources, scalar functions, grids and sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.functions import scalar as P
from emberframe.operators import grid as G
from emberframe.operators import lookback as W
from emberframe.operators import model as M
from emberframe.operators import polygons as Z
from emberframe.operators import sampling as A
from emberframe.plans.base import CELLS, CLIM, EV, FACT, PRED, cells, climate, events, fact, predictions, rounded, shared_folder, table, zones
from emberframe.sources import io as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CODES = {k: k % 6 for k in range(1, 40)}
CODE_SQL = "CASE WHEN code IS NULL THEN 0 WHEN code BETWEEN 1 AND 39 THEN code % 6 ELSE 2 END"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# sources

LONG = "long AS (SELECT ix, iy, x, y, u.variable, u.value FROM cells, (SELECT unnest(['v', 'code']) AS variable) k, LATERAL (SELECT k.variable, CASE WHEN k.variable = 'v' THEN v ELSE CAST(code AS DOUBLE) END AS value) u)"


@query(f"WITH {CELLS} SELECT ix, iy, round(v, 6) AS v, round(CAST(code AS DOUBLE), 6) AS code FROM cells")
def s01_widen_cells(spark, d):
    long = cells(spark, d).withColumn("code", F.col("code").cast("double")).unpivot(["ix", "iy"], ["v", "code"], "variable", "value")
    return rounded(S.widen_cells(long, ["v", "code"]))


@query(f"WITH {CLIM} SELECT loc, day, round(T, 6) AS T FROM clim WHERE day BETWEEN DATE '1996-01-15' AND DATE '1996-03-10'")
def s02_climate_range(spark, d):
    c = climate(spark, d).select("loc", "day", "T")
    return rounded(c.where(F.col("day").between(F.lit("1996-01-15").cast("date"), F.lit("1996-03-10").cast("date"))))


@query(f"WITH {CLIM} SELECT loc, day, round(T, 6) AS value FROM clim WHERE day BETWEEN DATE '1996-01-15' AND DATE '1996-03-10'")
def s02_climate_partitions(spark, d):
    """The daily grid written by variable, year and month, of which three folders of one variable are read."""
    path = shared_folder(spark, "climate")
    S.write_climate(climate(spark, d).unpivot(["loc", "day"], ["T", "P"], "variable", "value"), path)
    return rounded(S.read_climate(spark, path, "T", "1996-01-15", "1996-03-10").select("loc", "day", "value"))


@query(f"WITH {EV}, {CLIM}, p AS (SELECT id_obs, site_id % 100 AS loc, date FROM ev JOIN orders ON o_orderkey = id_obs WHERE o_orderstatus = 'P' AND year(date) = 1995) SELECT id_obs, round(coalesce(sum(T), 0) / 60, 6) AS T_cumulative_mean_60d, round(max(T), 6) AS T_cumulative_max_60d FROM p LEFT JOIN clim c ON c.loc = p.loc AND c.day <= p.date AND c.day > p.date - 60 GROUP BY 1")
def s02_event_months(spark, d):
    """Look-backs of the presences of one year, from the months of the partitioned grid that they touch."""
    path = shared_folder(spark, "climate")
    S.write_climate(climate(spark, d).unpivot(["loc", "day"], ["T", "P"], "variable", "value"), path)
    seen = table(spark, d, "orders").where("o_orderstatus = 'P' AND year(o_orderdate) = 1995").select(
        F.col("o_orderkey").alias("id_obs"), (F.col("o_custkey") % 100).alias("loc"), F.to_date("o_orderdate").alias("date"))
    near = S.read_climate_for(spark, path, "T", seen).select("loc", "day", F.col("value").alias("T"))
    return rounded(W.day_windows(seen, near, ["loc"], ["T"], (60,), 60).drop("loc", "date"))


@query(f"""WITH {CLIM}, k AS (SELECT DISTINCT site_id % 100 AS loc, date AS day FROM ({EV.removeprefix('ev AS ')})),
 j AS (SELECT k.loc, k.day, c.day AS nearest_day, c.T, row_number() OVER (PARTITION BY k.loc, k.day ORDER BY abs(date_diff('day', k.day, c.day)), c.day) AS rn FROM k JOIN clim c ON k.loc = c.loc)
 SELECT loc, day, nearest_day, round(T, 6) AS T FROM j WHERE rn = 1""")
def s03_asof_nearest_day(spark, d):
    keys = events(spark, d).select((F.col("site_id") % 100).alias("loc"), F.col("date").alias("day"))
    return rounded(S.asof_nearest_day(keys, climate(spark, d).select("loc", "day", "T")).where("nearest_day is not null"))


@query(f"WITH {CLIM}, g AS (SELECT DISTINCT loc, DATE '1997-06-01' + CAST(i AS INT) AS day FROM clim, range(30) t(i)) SELECT g.loc, CAST(g.day AS DATE) AS day, round(coalesce(c.T, 0), 6) AS value FROM g LEFT JOIN clim c ON g.loc = c.loc AND g.day = c.day")
def s04_absent_day_zero(spark, d):
    c = climate(spark, d)
    days = spark.range(30).select(F.date_add(F.lit("1997-06-01").cast("date"), F.col("id").cast("int")).alias("day"))
    grid = c.select("loc").distinct().crossJoin(F.broadcast(days))
    return rounded(S.with_absent_zero(grid, c.select("loc", "day", F.col("T").alias("value")), ["loc", "day"]))


VERS = "a AS (SELECT o_orderkey AS k, o_orderstatus AS g, o_totalprice AS v FROM orders), b AS (SELECT k, g, CASE WHEN k % 10 = 0 THEN v * 1.001 ELSE v END AS v FROM a WHERE k % 17 <> 0)"


def versions(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("g"), F.col("o_totalprice").alias("v"))
    return a, a.where("k % 17 <> 0").withColumn("v", F.when(F.col("k") % 10 == 0, F.col("v") * 1.001).otherwise(F.col("v")))


@query(f"WITH {VERS} SELECT coalesce(a.k, b.k) AS k, coalesce(a.g, b.g) AS g, round(a.v, 6) AS old_value, round(b.v, 6) AS new_value, CASE WHEN a.k IS NULL THEN 'OLD_MISSING' WHEN b.k IS NULL THEN 'NEW_MISSING' ELSE 'BOTH' END AS side FROM a FULL JOIN b ON a.k = b.k AND a.g = b.g")
def s05_pair_versions(spark, d):
    return rounded(S.pair_versions(*versions(spark, d), ["k", "g"], "v"))


@query("SELECT scenario, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT 'low' AS scenario, l_discount AS v FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'high', l_discount FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def s06_union_scenarios(spark, d):
    li = table(spark, d, "lineitem")
    part = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_discount").alias("v"))
    return rounded(S.union_scenarios({"low": part("A"), "high": part("R")}).groupBy("scenario").agg(F.count("*").alias("n"), F.sum("v").alias("total")), 4)


@query("WITH f AS (SELECT ['modelA_x_r1_v1', 'modelB_y_r1_v1', 'modelA_x_r2_v1', 'modelC_z_r1_v2'][1 + l_linenumber % 4] AS member, l_quantity AS v FROM lineitem) SELECT member, string_split(member, '_')[1] || '_' || string_split(member, '_')[2] AS model, count(*) AS n, round(sum(v), 4) AS total FROM f WHERE member <> 'modelC_z_r1_v2' GROUP BY 1, 2")
def s07_ensemble_files(spark, d):
    """One file a member under two folders, one of them broken on disk: it is skipped, the others are read with the ids in their names."""
    path = shared_folder(spark, "ensemble")
    members = ["modelA_x_r1_v1", "modelB_y_r1_v1", "modelA_x_r2_v1", "modelC_z_r1_v2"]
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 4).alias("k"), F.col("l_quantity").alias("v"))
    for k, name in enumerate(members):
        S.write_file(rows.where(F.col("k") == k).select("v"), f"{path}/part{k % 2}/tas_day_{name}_1995.parquet")
    S.cut_file(spark, f"{path}/part1/tas_day_{members[3]}_1995.parquet", 100)
    read = S.read_ensemble(spark, path)
    return rounded(read.groupBy("member", "model").agg(F.count("*").alias("n"), F.sum("v").alias("total")), 4)


@query("SELECT CAST(year(l_shipdate) AS INT) AS yr, make_date(CAST(year(l_shipdate) AS INT), 1, 1) AS day, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1, 2")
def s03_daily_files(spark, d):
    """One file a year, named by its first day; the day is read from the name."""
    path, li = shared_folder(spark, "daily"), table(spark, d, "lineitem").select(F.year("l_shipdate").alias("yr"), F.col("l_quantity").alias("value"))
    for r in li.select("yr").distinct().collect():  # seven years
        S.write_file(li.where(F.col("yr") == r.yr), f"{path}/strikes_{r.yr}0101_v2.parquet")
    read = S.read_daily_files(spark, path)
    return rounded(read.groupBy("yr", "day").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS INT) AS zone_id, s_name AS name, 2.0::DOUBLE * (3 + s_suppkey % 60) * (3 + s_suppkey % 60) + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS area FROM supplier")
def s04_zone_layer(spark, d):
    """A GeoJSON layer of one diamond a supplier, some with a second part, written as a file, read and measured."""
    s = table(spark, d, "supplier").withColumns({"r": (3 + F.col("s_suppkey") % 60).cast("double"), "cx": F.col("s_suppkey").cast("double")})
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    c, r = F.col("cx"), F.col("r")
    ring = F.array(point(c + r, F.lit(0)), point(c, r), point(c - r, F.lit(0)), point(c, -r), point(c + r, F.lit(0)))
    far = F.array(point(c, F.lit(500)), point(c + 1, F.lit(500)), point(c + 1, F.lit(501)), point(c, F.lit(501)))
    two = F.col("s_suppkey") % 4 == 0
    shape = F.when(two, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring), F.array(far)).alias("coordinates")))).otherwise(
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))
    feature = F.concat(F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct(F.col("s_name").alias("name"))), F.lit(', "geometry": '), shape, F.lit("}"))
    one = s.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", feature.alias("f")))), lambda e: e["f"]), ",\n").alias("all"))
    path = shared_folder(spark, "layer")  # a layer file is one document
    one.select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "all", F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    layer = Z.kept(S.read_zones(spark, path), shared_folder(spark, "zones"))  # parsed once for all branches
    return layer.select("zone_id", F.col("properties")["name"].alias("name")).join(Z.ring_area(Z.zone_edges(layer), 8.0, shared_folder(spark, "rings")), "zone_id")


@query(f"WITH {EV} SELECT CAST(year(date) AS INT) AS yr, count(*) AS n, count(CASE WHEN id_obs % 7 <> 0 THEN 1 END) AS n_known, round(sum(CASE WHEN id_obs % 7 <> 0 THEN x END), 4) AS total_x, min(date) AS first_day FROM ev GROUP BY 1")
def s05_event_files(spark, d):
    """Events written and read back, as Parquet and then as CSV; a NaN is missing from then on."""
    path = shared_folder(spark, "events")
    e = events(spark, d).select("id_obs", "date", F.when(F.col("id_obs") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x")).alias("x"))
    S.write_events(e, f"{path}/parquet")
    S.write_csv(S.read_events(spark, f"{path}/parquet"), f"{path}/csv")
    read = S.read_csv(spark, f"{path}/csv", "id_obs long, date date, x double")
    return rounded(read.groupBy(F.year("date").alias("yr")).agg(
        F.count("*").alias("n"), F.count("x").alias("n_known"), F.sum("x").alias("total_x"), F.min("date").alias("first_day")), 4)


@query("WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM lineitem GROUP BY 1) SELECT l_returnflag, CAST(l_linenumber AS INT) AS line, count(*) AS n, round(sum((l_quantity - mean) / std * (0.1 * l_linenumber)), 4) AS total FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1, 2")
def s10_model_tables(spark, d):
    """A scaler and weights saved as one model, loaded and applied."""
    li, path = table(spark, d, "lineitem"), shared_folder(spark, "model")
    weights = li.select(F.col("l_linenumber").alias("draw")).distinct().withColumn("beta", F.col("draw") * 0.1)
    S.save_model({"scaler": M.fit_scaler(li, ["l_quantity"], ["l_returnflag"]), "weights": weights}, path)
    model = S.load_model(spark, path, ["scaler", "weights"])
    scored = li.join(model["scaler"], "l_returnflag").join(model["weights"], F.col("l_linenumber") == F.col("draw"))
    return rounded(scored.groupBy("l_returnflag", F.col("l_linenumber").cast("int").alias("line")).agg(
        F.count("*").alias("n"), F.sum((F.col("l_quantity") - F.col("mean")) / F.col("std") * F.col("beta")).alias("total")), 4)


# scalar functions


@query(f"WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS code FROM part) SELECT p_partkey, {CODE_SQL} AS risk FROM p")
def p01_recode_landcover(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_size")).alias("code"))
    return p.select("p_partkey", P.recode(F.col("code"), CODES).alias("risk"))


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 5 WHEN 7 THEN 4 WHEN 8 THEN 1 WHEN 9 THEN 0 WHEN 10 THEN 0 ELSE 2 END AS risk FROM part")
def p02_recode_median_default(spark, d):
    return table(spark, d, "part").select("p_partkey", P.recode(F.col("p_size"), P.TEN_CLASS_RISK, "median").alias("risk"))


@query("SELECT p_partkey, " + ", ".join(f"CAST(p_size = {c} AS INT) AS landcover_{c}" for c in range(1, 11)) + " FROM part")
def p03_onehot_landcover(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("landcover"))
    return P.update_features(p, "landcover", "onehot")


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 5 WHEN 7 THEN 4 WHEN 8 THEN 1 WHEN 9 THEN 0 WHEN 10 THEN 0 ELSE 2 END AS landcover_risk FROM part")
def p04_update_features(spark, d):
    return P.update_features(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("landcover")), "landcover", "ordinal")


@query("SELECT p_size, count(*) AS n_rows FROM part WHERE p_size NOT BETWEEN 1 AND 39 GROUP BY 1")
def p05_unmapped_codes(spark, d):
    return P.unmapped_codes(table(spark, d, "part"), "p_size", CODES)


@query("WITH p AS (SELECT p_size % 6 AS level FROM part) SELECT level, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent, ['No risk', 'Very low', 'Low', 'Moderate', 'High', 'Very high'][level + 1] AS label FROM p GROUP BY level")
def p06_level_distribution(spark, d):
    return rounded(P.level_distribution(P.assert_range(table(spark, d, "part").select((F.col("p_size") % 6).alias("level")), "level", 0, 5), "level"))


@query("WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS a, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE p_retailprice END AS b FROM part) SELECT 'a' AS feature, round(avg(CAST(a IS NULL AS INT)) * 100, 6) AS missing_percent, avg(CAST(a IS NULL AS INT)) * 100 > 10 AS above_limit FROM p UNION ALL SELECT 'b', round(avg(CAST(b IS NULL AS INT)) * 100, 6), avg(CAST(b IS NULL AS INT)) * 100 > 10 FROM p")
def p07_missing_profile(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("a"), F.when(F.col("p_partkey") % 20 != 0, F.col("p_retailprice")).alias("b"))
    return rounded(P.missing_profile(p, ["a", "b"]))


@query(f"WITH {EV} SELECT id_obs, date FROM ev WHERE date >= DATE '1995-01-01' + 60 AND year(date) <= 2000")
def p08_prepare_events(spark, d):
    return P.prepare_events(events(spark, d), "date", "1995-01-01", 60, 2000).select("id_obs", "date")


@query("WITH f AS (SELECT p_partkey, string_split('tas_day_' || p_brand || '_' || p_type || '_r' || p_size || '_v1' || CASE WHEN p_partkey % 2 = 0 THEN '_x.nc' ELSE '' END, '_') AS t FROM part) SELECT p_partkey, CASE WHEN len(t) >= 6 THEN array_to_string(t[3:6], '_') END AS ensemble_id, CASE WHEN len(t) >= 6 THEN array_to_string(t[3:4], '_') END AS model_id FROM f")
def p09_ensemble_ids(spark, d):
    name = F.concat(F.lit("tas_day_"), "p_brand", F.lit("_"), "p_type", F.lit("_r"), F.col("p_size").cast("string"), F.lit("_v1"), F.when(F.col("p_partkey") % 2 == 0, "_x.nc").otherwise(""))
    return table(spark, d, "part").select("p_partkey", P.ensemble_id(name).alias("ensemble_id"), P.model_id(name).alias("model_id"))


@query("SELECT CASE WHEN m IN (12, 1, 2) THEN 'Winter' WHEN m IN (3, 4, 5) THEN 'Spring' WHEN m IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season, ['Winter', 'Spring', 'Summer', 'Fall'][CAST(ceil(m / 3.0) AS INT)] AS quarter_season, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][m] AS month_name, count(*) AS n FROM (SELECT CAST(month(o_orderdate) AS INT) AS m FROM orders) GROUP BY ALL")
def p10_seasons_and_months(spark, d):
    m = F.month("o_orderdate")
    return table(spark, d, "orders").groupBy(P.season(m).alias("season"), P.season(m, "quarter").alias("quarter_season"), P.month_name(m).alias("month_name")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax = 0 THEN NULL ELSE (l_discount - l_tax) / l_tax * 100 END, 6) AS pct_zero, round((l_discount - l_tax) / (l_tax + 0.001) * 100, 6) AS pct_offset, round(abs(l_discount - l_tax) / (abs(l_tax) + 1e-10) * 100, 3) AS pct_absolute FROM lineitem")
def p12_percent_change(spark, d):
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(P.pct_change(a, b), 6).alias("pct_zero"), (F.round(P.pct_change(a, b, "offset"), 6)).alias("pct_offset"), F.round(P.pct_change(a, b, "absolute"), 3).alias("pct_absolute"))


@query("WITH p AS (SELECT p_partkey, (p_size - 25) / 5.0::DOUBLE AS z, p_size / 51.0::DOUBLE AS q FROM part) SELECT p_partkey, round(1 / (1 + exp(-z)), 9) AS p, round(ln(q / (1 - q)), 9) AS logit_q, round(1 / (1 + exp(-(ln(q / (1 - q)) + ln(0.01 / 0.99) - ln(0.2 / 0.8)))), 9) AS corrected FROM p")
def p13_sigmoid_logit_prior(spark, d):
    q = F.col("p_size") / F.lit(51.0)
    return rounded(table(spark, d, "part").select("p_partkey", P.sigmoid((F.col("p_size") - 25) / F.lit(5.0)).alias("p"), P.logit(q).alias("logit_q"), P.prior_correct(q, 0.2, 0.01).alias("corrected")), 9)


@query("SELECT n_nationkey AS zone_id, CASE WHEN n_nationkey % 5 = 0 THEN 'Zone_' || n_nationkey ELSE n_name END AS zone_name FROM nation")
def p15_zone_names(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone_id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("NAME"))
    return P.zone_names(n).select("zone_id", "zone_name")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, 0.0::DOUBLE AS absent, coalesce(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END, 0) AS p_retailprice FROM part")
def p16_align_and_fill(spark, d):
    p = table(spark, d, "part").withColumn("p_retailprice", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")))
    return P.fill_missing(P.align_features(p, ["p_size", "absent", "p_retailprice"], ["p_partkey"]), ["p_retailprice"])


@query("WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS v FROM part) SELECT p_partkey, round(coalesce(v, (SELECT avg(v) FROM p)), 6) AS p_retailprice FROM p")
def p16_fill_mean(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    return rounded(P.fill_missing(p, ["p_retailprice"], "mean"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def p18_duplicate_keys(spark, d):
    return P.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 6 = 0")
def p18_empty_rows(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, 1).alias("a"), F.when(F.col("p_partkey") % 6 != 0, 1).alias("b"))
    return P.empty_rows(p, ["a", "b"]).select("p_partkey")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 1)")
def p19_drop_extreme(spark, d):
    return P.drop_extreme(table(spark, d, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "s_acctbal")


@query(f"WITH {EV} SELECT id_obs, date FROM ev WHERE month(date) IN (7, 8) AND year(date) BETWEEN 1996 AND 1998")
def p21_calendar_filter(spark, d):
    return P.calendar_filter(events(spark, d), "date", [7, 8], (1996, 1998)).select("id_obs", "date")


# grid and space


@query(f"WITH {EV} SELECT id_obs, CAST(least(greatest(floor(x / 50), 0), 19) AS INT) AS ix, CAST(least(greatest(floor(y / 50), 0), 19) AS INT) AS iy FROM ev")
def g01_to_cell(spark, d):
    return G.to_cell(events(spark, d), 0, 0, 50, 20, 20).select("id_obs", "ix", "iy")


PTS = "pts AS (SELECT *, CAST(least(floor(x / 10), 99) AS INT) AS ix, CAST(least(floor(y / 10), 99) AS INT) AS iy FROM ev)"


def located(spark, d):
    return G.to_cell(events(spark, d), 0, 0, 10, 100, 100)


@query(f"WITH {EV}, {PTS}, {CELLS} SELECT p.id_obs, count(*) AS n_cells, round(avg(c.v), 6) AS chip_mean FROM pts p JOIN cells c ON c.ix BETWEEN p.ix - 2 AND p.ix + 1 AND c.iy BETWEEN p.iy - 2 AND p.iy + 1 GROUP BY 1")
def g02_chip(spark, d):
    c = G.chip(located(spark, d).select("id_obs", "ix", "iy"), cells(spark, d).select("ix", "iy", "v"), 4)
    return rounded(c.groupBy("id_obs").agg(F.count("*").alias("n_cells"), F.avg("v").alias("chip_mean")))


@query(f"WITH {CELLS}, co AS (SELECT ix // 4 AS gx, iy // 4 AS gy, max(v) AS coarse FROM cells GROUP BY 1, 2) SELECT ix, iy, round(coarse, 6) AS coarse FROM cells JOIN co ON gx = ix // 4 AND gy = iy // 4")
def g03_regrid(spark, d):
    c = cells(spark, d)
    coarse = c.groupBy(F.expr("ix div 4").cast("int").alias("gx"), F.expr("iy div 4").cast("int").alias("gy")).agg(F.max("v").alias("coarse"))
    return rounded(G.regrid(c, coarse, 4).select("ix", "iy", "coarse"))


@query(f"WITH {CELLS} SELECT ix, iy FROM cells WHERE x >= 500 AND y <= x - 500")
def g04_clip_cells(spark, d):
    return G.clip_cells(cells(spark, d), [(500.0, 0.0), (1000.0, 0.0), (1000.0, 500.0)]).select("ix", "iy")


@query(f"WITH {CELLS} SELECT ix, iy FROM cells WHERE x + 5 >= 500 AND x - 5 <= 1000 AND y - 5 <= least(x + 5, 1000) - 500")
def g04_touched_cells(spark, d):
    return G.clip_cells(cells(spark, d), [(500.0, 0.0), (1000.0, 0.0), (1000.0, 500.0)], 5.0).select("ix", "iy")


@query(f"WITH {CELLS}, {EV} SELECT ix, iy FROM cells c WHERE NOT EXISTS (SELECT 1 FROM ev q WHERE (q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) <= 625)")
def g05_exclude_within(spark, d):
    return G.exclude_within(cells(spark, d), events(spark, d), 25.0).select("ix", "iy")


@query(f"WITH {CELLS}, {EV} SELECT ix, iy FROM cells c WHERE x < 800 AND code % 6 > 0 AND NOT EXISTS (SELECT 1 FROM ev q WHERE (q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) <= 400)")
def g06_sampling_area(spark, d):
    c = cells(spark, d).withColumn("risk", F.col("code") % 6)
    return G.sampling_area(c, c.where("x < 800"), events(spark, d), 20.0, "risk").select("ix", "iy")


# Strict inequalities: the zones written out, boundaries excluded.
SHAPE = {
    1: "{x} > 0 AND {x} < 400 AND {y} > 0 AND {y} < 400",
    2: "{x} < 1000 AND {y} > 0 AND {y} < {x} - 500",
    3: "{x} > 0 AND {x} < 450 AND {y} > 500 AND {y} < 1000 AND NOT ({x} BETWEEN 100 AND 300 AND {y} BETWEEN 600 AND 800)",
    4: "{x} > 500 AND {x} < 1000 AND {y} > 600 AND {y} < 1000 AND NOT ({x} >= 600 AND {y} >= 700)",
    5: "({x} > 650 AND {x} < 750 AND {y} > 750 AND {y} < 850) OR ({x} > 800 AND {x} < 950 AND {y} > 720 AND {y} < 950 AND NOT ({x} BETWEEN 820 AND 930 AND {y} BETWEEN 740 AND 930)) OR ({x} > 850 AND {x} < 900 AND {y} > 800 AND {y} < 850)",
}
AREAS = "areas(zone_id, area) AS (VALUES (1, 160000.0::DOUBLE), (2, 125000), (3, 185000), (4, 80000), (5, 26100))"


def in_zones(table: str, key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {z} AS zone_id FROM {table} WHERE {shape.format(x='x', y='y')}" for z, shape in SHAPE.items())


@query(f"WITH {EV} " + in_zones("ev", "id_obs"))
def g07_zone_join(spark, d):
    return Z.zone_join(events(spark, d), Z.zone_edges(zones(spark)), "id_obs", 20.0, shared_folder(spark, "tiles"))


DIAMONDS = "dia AS (SELECT s_suppkey AS zone_id, CAST((s_suppkey * 7907) % 1000 AS DOUBLE) AS cx, CAST((s_suppkey * 6007) % 1000 AS DOUBLE) AS cy, CAST(3 + s_suppkey % 60 AS DOUBLE) AS r FROM supplier)"


@query(f"WITH {EV}, {DIAMONDS} SELECT zone_id, count(*) AS n_points, count(DISTINCT date) AS n_days, sum(id_obs)::BIGINT AS ids FROM ev JOIN dia ON abs(x - cx) + abs(y - cy) < r GROUP BY 1")
def g07_zone_layer(spark, d):
    """A layer that grows with the data: one diamond per supplier, overlapping; all events, of which many share a place."""
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("zone_id"), (F.col("s_suppkey") * 7907 % 1000).cast("double").alias("cx"), (F.col("s_suppkey") * 6007 % 1000).cast("double").alias("cy"),
        (3 + F.col("s_suppkey") % 60).cast("double").alias("r"))
    corner = lambda dx, dy: F.struct((F.col("cx") + dx * F.col("r")).alias("x"), (F.col("cy") + dy * F.col("r")).alias("y"))
    layer = s.select("zone_id", F.array(F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1))).alias("rings"))
    return Z.zone_days(events(spark, d), layer, "id_obs", 4.0, shared_folder(spark, "tiles"))


@query(f"WITH {CELLS} SELECT a.ix, a.iy, round(CASE WHEN count(b.v) = 16 THEN avg(b.v) END, 6) AS focal FROM cells a JOIN cells b ON b.ix BETWEEN a.ix - 2 AND a.ix + 1 AND b.iy BETWEEN a.iy - 2 AND a.iy + 1 GROUP BY 1, 2")
def g08_focal_mean(spark, d):
    return rounded(G.focal_mean(cells(spark, d), "v"))


@query(f"WITH {CELLS} SELECT a.ix, a.iy, round(avg(b.v), 6) AS focal FROM cells a JOIN cells b ON b.ix BETWEEN a.ix - 2 AND a.ix + 1 AND b.iy BETWEEN a.iy - 2 AND a.iy + 1 GROUP BY 1, 2")
def g08_focal_mean_shrinking(spark, d):
    return rounded(G.focal_mean(cells(spark, d), "v", 4, 1))


@query(f"WITH {CELLS} SELECT ix // 3 AS bx, iy // 3 AS by, round(avg(v), 6) AS block_mean FROM cells GROUP BY 1, 2 HAVING count(*) = 9")
def g09_coarsen(spark, d):
    return rounded(G.coarsen(cells(spark, d), "v", 3))


@query(f"WITH {CELLS} SELECT ix, iy FROM cells WHERE ix % 3 = 0 AND iy % 3 = 0")
def g09_every_kth(spark, d):
    return G.every_kth(cells(spark, d), 3).select("ix", "iy")


@query(f"WITH {EV}, {PTS}, {CELLS} SELECT id_obs, round(v, 6) AS v FROM pts LEFT JOIN cells ON pts.ix = cells.ix AND pts.iy = cells.iy")
def g10_sample_at(spark, d):
    return rounded(G.sample_at(located(spark, d), cells(spark, d).select("ix", "iy", "v")).select("id_obs", "v"))


@query(f"WITH {CELLS} SELECT ix, iy FROM cells WHERE code % 3 <> 0")
def g11_prediction_grid(spark, d):
    return G.prediction_grid(cells(spark, d).withColumn("t", F.when(F.col("code") % 3 != 0, F.col("v"))), "t")


INZ = f"inz AS ({in_zones('ev', 'id_obs')})"


@query(f"WITH {EV}, {INZ}, s AS (SELECT o_orderkey AS id_obs, o_totalprice AS r FROM orders) SELECT zone_id, round(avg(r), 6) AS mean_risk, round(max(r), 6) AS max_risk, round(stddev_samp(r), 6) AS spatial_std, round(quantile_cont(r, 0.9), 6) AS p90, count(r) AS n FROM inz JOIN s USING (id_obs) GROUP BY 1")
def g12_zonal_stats(spark, d):
    pred = table(spark, d, "orders").select(F.col("o_orderkey").alias("id_obs"), F.col("o_totalprice").alias("r"))
    inside = Z.zone_join(events(spark, d), Z.zone_edges(zones(spark)), "id_obs", 20.0, shared_folder(spark, "tiles"))
    return rounded(G.zonal_stats(pred, inside, "id_obs", "r", shared_folder(spark, "zonal")))


COVERED = f"slivers AS (SELECT 100 + i AS zone_id, 60.0 * i AS x0, CASE WHEN i % 2 = 0 THEN 8 ELSE 4 END AS w FROM range(16) t(i)), names AS (SELECT unnest([1, 2, 3, 4, 5]) AS zone_id UNION ALL SELECT zone_id FROM slivers), inc AS ({in_zones('cells', 'ix, iy, x')} UNION ALL SELECT ix, iy, x, zone_id FROM cells JOIN slivers ON x > x0 AND x < x0 + w AND y > 0 AND y < 40), cov AS (SELECT names.zone_id, count(ix) AS n_cells, count(CASE WHEN x < 800 THEN 1 END) AS n_inside FROM names LEFT JOIN inc ON inc.zone_id = names.zone_id GROUP BY 1)"


def coverage(spark, d):
    """Zones and 16 slivers, half of which hold the middle of no cell."""
    box = lambda x, w: [[(x, 0.0), (x + w, 0.0), (x + w, 40.0), (x, 40.0)]]
    slivers = spark.createDataFrame([(100 + i, box(60.0 * i, 8.0 if i % 2 == 0 else 4.0)) for i in range(16)], zones(spark).schema)
    c, layer = cells(spark, d).select("ix", "iy", "x", "y"), zones(spark).unionByName(slivers)
    found = Z.within(c, Z.zone_tiles(Z.zone_edges(layer), 20.0, shared_folder(spark, "tiles")))
    return Z.zone_coverage(found, c.where("x < 800"), 100.0, layer), c.where("x < 800")


@query(f"WITH {CELLS}, {COVERED} SELECT CAST(zone_id AS INT) AS zone_id, n_cells, n_cells * 100.0::DOUBLE AS area, n_inside, round(n_inside / nullif(CAST(n_cells AS DOUBLE), 0), 6) AS share_inside FROM cov")
def g13_zone_coverage(spark, d):
    return rounded(coverage(spark, d)[0])


@query(f"WITH {CELLS}, {COVERED} SELECT count(*) AS n_zones, count(CASE WHEN n_inside > 0 THEN 1 END) AS n_kept, count(CASE WHEN n_inside = 0 THEN 1 END) AS n_removed, round(count(CASE WHEN n_inside = 0 THEN 1 END) * 100.0 / count(*), 6) AS removed_percent, sum(n_cells) * 100.0::DOUBLE AS area, sum(n_inside) * 100.0::DOUBLE AS clipped_area, (SELECT count(*) FROM cells WHERE x < 800) * 100.0::DOUBLE AS aoi_area, round((1 - sum(n_inside) / CAST(sum(n_cells) AS DOUBLE)) * 100, 6) AS reduction_percent, round(sum(n_inside) * 100.0 / (SELECT count(*) FROM cells WHERE x < 800), 6) AS coverage_percent FROM cov")
def g13_clip_summary(spark, d):
    return rounded(Z.clip_summary(*coverage(spark, d), 100.0))


@query(f"WITH {EV}, {INZ}, {AREAS} SELECT CAST(areas.zone_id AS INT) AS zone_id, area, count(id_obs) AS n_events, round(count(id_obs) / area * 100, 6) AS per_100 FROM areas LEFT JOIN inz ON areas.zone_id = inz.zone_id GROUP BY 1, area")
def g14_area_and_g17_density(spark, d):
    edges = Z.zone_edges(zones(spark))
    return rounded(Z.event_density(Z.zone_join(events(spark, d), edges, "id_obs", 20.0, shared_folder(spark, "tiles")), Z.ring_area(edges, 20.0, shared_folder(spark, "rings"))))


@query(f"WITH {EV}, {CELLS}, a AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM ev), b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM cells) SELECT greatest(a.x0, b.x0) AS min_x, least(a.x1, b.x1) AS max_x, greatest(a.y0, b.y0) AS min_y, least(a.y1, b.y1) AS max_y, greatest(a.x0, b.x0) <= least(a.x1, b.x1) AND greatest(a.y0, b.y0) <= least(a.y1, b.y1) AS overlaps FROM a, b")
def g15_extent_overlap(spark, d):
    return G.overlap(events(spark, d), cells(spark, d))


@query(f"WITH {EV} SELECT id_obs FROM ev WHERE x BETWEEN 100 AND 300 AND y BETWEEN 200 AND 700")
def g16_crop(spark, d):
    return G.crop(events(spark, d), 100, 200, 300, 700).select("id_obs")


# sampling


@query(f"WITH {EV}, r AS (SELECT id_obs, i AS rep, CAST(i = 0 AS INT) AS bin, md5('7:' || id_obs || ':' || i) AS h FROM ev, (SELECT CAST(range AS INT) AS i FROM range(5))) SELECT id_obs, rep, bin, CAST(DATE '1995-03-02' + CAST(('0x' || substr(h, 1, 8))::BIGINT % (date_diff('day', DATE '1995-03-02', DATE '2000-12-31') + 1) AS INT) AS DATE) AS rand_date FROM r")
def a01_replicate_random_date(spark, d):
    r = A.replicate(events(spark, d).select("id_obs"), 5)
    return A.random_date(r, "1995-03-02", "2000-12-31", 7, "id_obs", "rep").select("id_obs", "rep", "bin", "rand_date")


@query(f"WITH {EV}, p AS (SELECT o_custkey AS site_id, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'P') SELECT id_obs FROM ev c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.site_id = c.site_id AND c.date BETWEEN p.date - 60 AND p.date + 365)")
def a03_exclude_period(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("site_id"), F.to_date("o_orderdate").alias("date"))
    return A.exclude_period(events(spark, d), seen, "site_id", "date", 60, 365).select("id_obs")


@query(f"WITH {EV}, r AS (SELECT id_obs, CAST(month(date) AS INT) AS mon, row_number() OVER (PARTITION BY month(date) ORDER BY md5('42:' || id_obs), id_obs) AS rn FROM ev) SELECT mon, id_obs FROM r WHERE rn <= 20")
def a04_sample_per_group(spark, d):
    e = events(spark, d).withColumn("mon", F.month("date"))
    return A.sample_per_group(e, ["mon"], 20, 42, "id_obs").select("mon", "id_obs")


@query("WITH c AS (SELECT o_orderkey FROM orders ORDER BY md5('5:' || o_orderkey), o_orderkey LIMIT 300) SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 999 AS new_id FROM c")
def a05_sample_cells(spark, d):
    return A.number_from(A.sample_rows(table(spark, d, "orders").select("o_orderkey"), 300, 5, "o_orderkey"), 1000, "o_orderkey")


@query("WITH c AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P' ORDER BY md5('5:' || o_orderkey), o_orderkey LIMIT (SELECT 2 * count(*) FROM orders WHERE o_orderstatus = 'P')) SELECT o_orderkey, (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'P') + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS new_id FROM c")
def a05_sample_absences(spark, d):
    """Twice as many absences as presences, numbered from the largest presence on."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    seen = o.where("o_orderstatus = 'P'").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top")).first()
    drawn = A.sample_rows(o.where("o_orderstatus <> 'P'"), 2 * seen.n, 5, "o_orderkey")
    return A.number_from(drawn, (seen.top or 0) + 1, "o_custkey", "o_orderkey").select("o_orderkey", "new_id")


@query(f"""WITH {EV}, p AS (SELECT * FROM ev WHERE id_obs % 40 = 0), a AS (SELECT * FROM ev WHERE id_obs % 40 <> 0),
 t AS (SELECT month(date) AS mon, CAST(round_even(count(*) / CAST((SELECT count(*) FROM p) AS DOUBLE) * 5 * (SELECT count(*) FROM p), 0) AS BIGINT) AS target FROM p GROUP BY 1),
 r AS (SELECT id_obs, month(date) AS mon, row_number() OVER (PARTITION BY month(date) ORDER BY md5('42:' || id_obs), id_obs) AS rn FROM a)
 SELECT CAST(r.mon AS INT) AS mon, id_obs FROM r JOIN t ON r.mon = t.mon WHERE rn <= target""")
def a07_stratified_by_month(spark, d):
    e = events(spark, d)
    return A.stratified_by_month(e.where("id_obs % 40 <> 0"), e.where("id_obs % 40 = 0"), 5, 42, "id_obs").select("mon", "id_obs")


@query(f"WITH {EV} SELECT row_number() OVER (ORDER BY date, id_obs) - 1 AS id_obs, id_obs AS source_id FROM ev")
def a08_dense_ids(spark, d):
    e = events(spark, d).select("date", F.col("id_obs").alias("source_id"))
    return A.dense_ids(e, "date", "source_id").select("id_obs", "source_id")


@query(f"WITH {EV} SELECT CAST(month(date) AS INT) AS row_key, count(CASE WHEN id_obs % 6 = 0 THEN 1 END) AS \"1\", count(CASE WHEN id_obs % 6 <> 0 THEN 1 END) AS \"0\" FROM ev GROUP BY 1")
def a09_crosstab(spark, d):
    e = events(spark, d).withColumn("bin", (F.col("id_obs") % 6 == 0).cast("int"))
    return A.crosstab(e, F.month("date"), "bin", [0, 1])


@query(f"WITH {PRED}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('1:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM pred) SELECT doc_id, label, rn <= ceil(n * 0.3::DOUBLE) AS is_test FROM r")
def a10_train_test_split(spark, d):
    return A.train_test_split(predictions(spark, d), "label", 0.3, 1, "doc_id").select("doc_id", "label", "is_test")


@query(f"WITH {EV} SELECT (CASE WHEN (x - 250) * (x - 250) + (y - 250) * (y - 250) <= (x - 750) * (x - 750) + (y - 750) * (y - 750) THEN '0' ELSE '1' END) || '-' || (CAST(year(date) >= 1997 AS INT) + CAST(year(date) >= 1999 AS INT)) AS fold, count(*) AS n FROM ev GROUP BY 1 HAVING sum(CAST(id_obs % 40 = 0 AS INT)) > 0")
def a12_spacetime_folds(spark, d):
    e = events(spark, d).withColumn("label", (F.col("id_obs") % 40 == 0).cast("int"))
    return A.spacetime_folds(e, [(250.0, 250.0), (750.0, 750.0)], [1997, 1999]).groupBy("fold").agg(F.count("*").alias("n"))


@query()
def a12_spatial_folds(spark, d):
    """Folds around fitted centres: no SQL form; a test checks that planted clusters become folds."""
    e = events(spark, d).withColumn("label", (F.col("id_obs") % 40 == 0).cast("int"))
    return A.spacetime_folds(e, A.spatial_centres(e, 3, 1), [1997]).groupBy("fold").agg(F.count("*").alias("n"))


@query(f"WITH {CLIM} SELECT loc, day FROM clim WHERE date_diff('day', DATE '1995-01-01', day) % 100 = 0")
def a14_thin(spark, d):
    return A.thin(climate(spark, d), "day", "1995-01-01", 100).select("loc", "day")
