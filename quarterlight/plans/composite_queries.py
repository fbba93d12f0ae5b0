"""Queries composed of several operators: clusters, point features, datasets, models and calibration chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import physics as H
from ..functions import time as T
from ..functions.numeric import rounded
from ..operators import calendar as CA
from ..operators import calibration as C
from ..operators import clustering as K
from ..operators import evaluation as E
from ..operators import folds as M
from ..operators import grid as G
from ..operators import lags as L
from ..operators import linear as R
from ..operators import recursive as RC
from ..operators import spatial as S
from ..operators import weather as W
from ..sources.files import settle, shared_folder, write_bundle
from .calendar_queries import holidays
from .frames import AREAS, CLUSTERS, DAY, LOCAL, MTU, PANEL, SERIES, areas, clusters, out, panel, query, series
from .model_queries import _FOLDS, _H, area_days, hourly_panel
from .spatial_queries import _POINTS, centres, points
from .weather_queries import WEATHER, curve, weather


@query("D5_points_to_capacity", f"WITH {_POINTS}, own AS (SELECT p.id, min({{'d2': (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), 'p': c.cluster_id}}) AS m FROM pts p JOIN ctr c ON c.region = p.region GROUP BY p.id) SELECT p.region, m.p AS point, round(sum(mw), 6) AS mw, count(*) AS units FROM own JOIN pts p USING (id) GROUP BY 1, 2")
def d5(spark, d):
    n = S.nearest(points(spark, d), centres(spark, d), "cluster_id", within=["region"], count=40).where("cluster_id IS NOT NULL")
    return out(n.groupBy("region", F.col("cluster_id").alias("point")).agg(F.sum("mw").alias("mw"), F.count(F.lit(1)).alias("units")), ["region", "point"], "mw", "units")


@query("D10_kmeans")
def d10(spark, d):
    c = K.kmeans(points(spark, d), 8)
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("x"), 4).alias("x"), rounded(F.avg("y"), 4).alias("y"))


@query("D11_weighted_kmeans")
def d11(spark, d):
    units = points(spark, d)
    c = K.kmeans(units, 8, weight="mw")
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("mw"), 4).alias("mw"))


@query("D12_kmeans_by_area")
def d12(spark, d):
    """Clusters of each control area; a cell's units go, whatever their own area, to the clusters of the area with most capacity in the cell."""
    own = points(spark, d).withColumn("area", (F.col("region") % 3).cast("int"))
    return out(K.kmeans_by_dominant_area(own, "area", [0, 1, 2], 3, 0.1, "mw"), ["id", "area", "cell_x", "cell_y", "cell_area", "cluster"], "mw")


@query("D14_representatives")
def d14(spark, d):
    return out(K.representatives(points(spark, d), 6).withColumn("x", F.round("x", 4)).withColumn("y", F.round("y", 4)), ["cluster"], "x", "y", "mw", "n")


@query("D16_numbered_points", f"""WITH {_POINTS}, g AS (SELECT region, round(x / 0.1)::BIGINT AS cx, round(y / 0.1)::BIGINT AS cy, sum(mw) AS mw, count(*) AS n FROM pts GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mw DESC, n DESC, cx, cy) AS k FROM g)
SELECT region, cx, cy, round(mw, 6) AS mw, row_number() OVER (ORDER BY region, k)::INTEGER AS point_id FROM r WHERE k <= 2""")
def d16(spark, d):
    t = S.top_cells(points(spark, d), ["region"], 0.1, 2, 0.0)
    return out(t.withColumn("point_id", F.row_number().over(Window.orderBy("region", "rank"))), ["region", "cx", "cy"], "mw", "point_id")


@query("D27_point_metadata", f"WITH {_POINTS}, h AS (SELECT region, mw, 80 + id % 60 AS hub, 50 + id % 30 AS rotor FROM pts) SELECT region, round(sum(mw * hub) / sum(mw), 6) AS hub, round(sum(rotor * rotor), 6) AS area_weight, round(sum(mw * rotor * rotor), 4) AS product_weight, round(sum(mw), 6) AS capacity_weight FROM h GROUP BY 1")
def d27(spark, d):
    h = points(spark, d).withColumn("hub", 80.0 + F.col("id") % 60).withColumn("rotor", 50.0 + F.col("id") % 30)
    mw, r2 = F.col("mw"), F.col("rotor") * F.col("rotor")
    return h.groupBy("region").agg(rounded(F.sum(mw * F.col("hub")) / F.sum("mw")).alias("hub"), rounded(F.sum(r2)).alias("area_weight"), rounded(F.sum(mw * r2), 4).alias("product_weight"), rounded(F.sum("mw")).alias("capacity_weight"))


@query("E13_point_features", f"""WITH {WEATHER}, x AS (SELECT ts, region, cap, speed AS s80, speed * 1.15 AS s120, greatest(0, speed + greatest(-1, least(2.5, (70 + 20 * cluster_id - 80) / 40)) * (speed * 1.15 - speed)) AS hub, speed * 1.6 AS gust FROM weather)
SELECT ts, region, round(sum(cap * {curve('hub')}) + 1e-9, 5) AS proxy_mw, round(sum(cap * hub) / sum(cap) + 1e-9, 6) AS hub_speed, round(sum(cap * (s120 - s80)) / sum(cap) + 1e-9, 6) AS shear, round(sum(cap * gust) / sum(cap) / greatest(sum(cap * s80) / sum(cap), 0.1) + 1e-9, 6) AS gust_ratio FROM x GROUP BY 1, 2""")
def e13(spark, d):
    s, cap = F.col("speed"), F.col("cap")
    x = weather(spark, d).withColumn("hub", H.hub_speed(s, s * 1.15, 70.0 + 20 * F.col("cluster_id")))
    return x.groupBy("ts", "region").agg(
        N.rounded_up(F.sum(cap * H.power_curve(F.col("hub"))), 5).alias("proxy_mw"), N.rounded_up(W.mean0(F.col("hub"), cap)).alias("hub_speed"),
        N.rounded_up(W.mean0(s * 1.15 - s, cap)).alias("shear"), N.rounded_up(W.mean0(s * 1.6, cap) / F.greatest(W.mean0(s, cap), F.lit(0.1))).alias("gust_ratio"),
    )


@query("E14_simple_proxy", f"""WITH {WEATHER}, h AS (SELECT ts, sum(cap * {curve('speed * pow(10, 1 / 7)')}) AS wind, sum(cap * ghi / 1000) AS solar FROM weather GROUP BY 1),
e AS (SELECT min({DAY}) AS a, max({DAY}) AS z FROM h), s AS (SELECT unnest(generate_series(a::TIMESTAMP - INTERVAL 1 HOUR, z::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 75 MINUTE, INTERVAL 15 MINUTE)) AS ts FROM e),
g AS (SELECT ts, wind, solar FROM s LEFT JOIN h USING (ts))
SELECT ts, round(last_value(wind IGNORE NULLS) OVER w, 5) AS wind, round(last_value(solar IGNORE NULLS) OVER w, 5) AS solar FROM g WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def e14(spark, d):
    cap = F.col("cap")
    h = weather(spark, d).groupBy("ts").agg(F.sum(cap * H.power_curve(H.shear(F.col("speed"), 10.0, 100.0))).alias("wind"), F.sum(cap * F.col("ghi") / 1000).alias("solar"))
    g = G.dense_grid(h, []).join(h, "ts", "left")
    return g.select("ts", rounded(G.forward_fill(g, [], "wind"), 5).alias("wind"), rounded(G.forward_fill(g, [], "solar"), 5).alias("solar"))


@query("E17_load_weather", f"WITH {WEATHER} SELECT ts, round(avg(t2m) - 273.15, 6) AS t2m_c, round(avg(greatest(15 - (t2m - 273.15), 0)), 6) AS hdd, round(avg(ghi), 6) AS solar, round(avg(speed), 6) AS speed FROM weather GROUP BY 1")
def e17(spark, d):
    c = F.col("t2m") - 273.15
    return weather(spark, d).groupBy("ts").agg(rounded(F.avg("t2m") - 273.15).alias("t2m_c"), rounded(F.avg(F.greatest(15 - c, F.lit(0.0)))).alias("hdd"), rounded(F.avg("ghi")).alias("solar"), rounded(F.avg("speed")).alias("speed"))


@query("E26_spread_regime", f"WITH {WEATHER}, m AS (SELECT ts, region, avg(speed) AS mean, stddev_pop(speed) AS std FROM weather GROUP BY 1, 2) SELECT ts, region, round(CASE WHEN mean >= 8 THEN std ELSE 0 END + 1e-9, 5) AS high_spread, round(std * greatest(mean - 8, 0) + 1e-9, 5) AS spread_excess FROM m")
def e26(spark, d):
    m = weather(spark, d).groupBy("ts", "region").agg(F.avg("speed").alias("mean"), F.stddev_pop("speed").alias("std"))
    return m.select("ts", "region", N.rounded_up(F.when(F.col("mean") >= 8, F.col("std")).otherwise(0.0), 5).alias("high_spread"), N.rounded_up(F.col("std") * F.greatest(F.col("mean") - 8, F.lit(0.0)), 5).alias("spread_excess"))


@query("F18_leak_guard", f"WITH {AREAS} SELECT ts, round(max(v) FILTER (area = 'click'), 6) AS load, round(max(v) FILTER (area = 'view'), 6) AS wind, round(max(v) FILTER (area = 'click') + max(v) FILTER (area = 'view'), 6) AS total FROM areas GROUP BY ts")
def f18(spark, d):
    w = areas(spark, d).groupBy("ts").pivot("area", ["click", "view", "error"]).agg(F.max("v")).withColumnsRenamed({"click": "load", "view": "wind", "error": "load_Actual_MW"})
    safe = w.select(*[c for c in w.columns if "Actual" not in c])
    return out(safe.withColumn("total", F.col("load") + F.col("wind")), ["ts"], "load", "wind", "total")


@query("F19_route_covariates", f"WITH {SERIES}, l AS (SELECT {DAY} AS local_day, ts, {MTU} AS m, v FROM series) SELECT local_day, round(arg_max(v, ts), 6) AS scalar, round(avg(v), 6) AS mean, round(avg(v) FILTER (m = 0), 6) AS v_mtu_00, round(avg(v) FILTER (m = 95), 6) AS v_mtu_95 FROM l GROUP BY 1")
def f19(spark, d):
    s = series(spark, d)
    scalar = G.day_last(s, []).withColumnRenamed("v", "scalar")
    both = scalar.join(G.day_summary(s, []).select("local_day", "mean"), "local_day").join(G.day_matrix(s, []), "local_day")
    return out(both, ["local_day"], "scalar", "mean", "v_mtu_00", "v_mtu_95")


def dataset(spark, d):
    """ts, day, id, features and target y of the load model: lags, partial day, calendar. The series is computed once."""
    s = settle(series(spark, d))
    here = T.local(F.col("ts"))
    x = L.lag_by_time(s, [], [1, 7]).withColumn("day", T.local_day(F.col("ts")))
    off = holidays(spark).select("day").distinct().withColumn("holiday", F.lit(1.0))
    x = x.join(L.partial_day(s, [], [0], 600, 7), "day", "left").join(F.broadcast(off), "day", "left")
    weekend = (F.weekday(here) >= 5).cast("double")
    return x.select("ts", "day", T.seconds(F.col("ts")).alias("id"), "v_lag_1d", "v_lag_7d", "mean_00", "diff_00", F.hour(here).cast("double").alias("hour"), weekend.alias("weekend"), F.coalesce("holiday", F.lit(0.0)).alias("holiday"), F.col("v").alias("y"))


FEATURES = ["v_lag_1d", "v_lag_7d", "mean_00", "diff_00", "hour", "weekend", "holiday"]


@query("F21_daily_dataset", f"WITH {SERIES}, l AS (SELECT {DAY} AS day, avg(v) AS v FROM series GROUP BY 1), p AS (SELECT a.day, a.v AS y, b.v AS d1, c.v AS d7 FROM l a LEFT JOIN l b ON b.day = a.day - 1 LEFT JOIN l c ON c.day = a.day - 7) SELECT day, round(y + 1e-9, 6) AS y, round(d1 + 1e-9, 6) AS d1, round(d7 + 1e-9, 6) AS d7, d1 IS NOT NULL AND d7 IS NOT NULL AS usable FROM p UNION ALL SELECT max(day) + 1, NULL, round(arg_max(v, day) + 1e-9, 6), (SELECT round(v + 1e-9, 6) FROM l WHERE day = (SELECT max(day) - 6 FROM l)), TRUE FROM l")
def f21(spark, d):
    l = series(spark, d).groupBy(T.local_day(F.col("ts")).alias("day")).agg(F.avg("v").alias("v"))
    days = l.select("day").union(l.agg(F.date_add(F.max("day"), 1)))  # the future day has features but no truth
    x = days.join(l.withColumnRenamed("v", "y"), "day", "left")
    for n in (1, 7):
        x = x.join(l.select(F.date_add("day", n).alias("day"), F.col("v").alias(f"d{n}")), "day", "left")
    return x.select("day", *[N.rounded_up(F.col(c)).alias(c) for c in ("y", "d1", "d7")], (F.col("d1").isNotNull() & F.col("d7").isNotNull()).alias("usable"))


@query("F22_feature_table", f"""WITH {SERIES}, s0 AS (SELECT {DAY} AS day, avg(v) AS m FROM series WHERE hour({LOCAL}) * 60 + minute({LOCAL}) BETWEEN 0 AND 600 GROUP BY 1), p AS (SELECT a.day + 1 AS day, a.m FROM s0 a)
SELECT s.ts, round(s.v, 6) AS y, round(b.v, 6) AS v_lag_1d, round(c.v, 6) AS v_lag_7d, round(p.m, 6) AS mean_00, hour(s.ts + INTERVAL 1 HOUR)::DOUBLE AS hour FROM series s LEFT JOIN series b ON b.ts = s.ts - INTERVAL 1 DAY LEFT JOIN series c ON c.ts = s.ts - INTERVAL 7 DAY LEFT JOIN p ON p.day = (s.ts + INTERVAL 1 HOUR)::DATE""")
def f22(spark, d):
    return out(dataset(spark, d), ["ts"], "y", "v_lag_1d", "v_lag_7d", "mean_00", "hour")


@query("G4_test_scaling", f"WITH {_FOLDS}, s AS (SELECT fold, area, min(v) AS lo, max(v) AS hi FROM folds WHERE split = 'train' GROUP BY 1, 2) SELECT fold, area, round(CASE WHEN hi - lo > 1e-9 THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM folds JOIN s USING (fold, area) WHERE split = 'test'")
def g4(spark, d):
    rows = settle(area_days(spark, d).select("area", "day", "v"))
    f = rows.withColumnRenamed("day", "fold").join(M.window_extremes(rows, ["area"], "day", "v", 7, 20), ["fold", "area"])
    return out(f.withColumn("scaled", M.scaled_between(F.col("v"), F.col("lo"), F.col("hi"))), ["fold", "area"], "scaled")


@query("G9_baseline_choice", f"WITH {PANEL}, w AS (SELECT ts, max(y_pred) FILTER (model = 'naive_d7') AS b, max(y_pred) FILTER (model = 'naive_d1') AS a FROM panel GROUP BY ts) SELECT s.ts, round(coalesce(b, a, 0), 6) AS baseline, CASE WHEN b IS NOT NULL THEN 'naive_d7' WHEN a IS NOT NULL THEN 'naive_d1' ELSE 'none' END AS source FROM series s LEFT JOIN w USING (ts)")
def g9(spark, d):
    w = panel(spark, d).groupBy("ts").pivot("model", ["naive_d1", "naive_d7"]).agg(F.max("y_pred"))
    j = series(spark, d).join(w, "ts", "left")
    source = F.when(F.col("naive_d7").isNotNull(), "naive_d7").when(F.col("naive_d1").isNotNull(), "naive_d1").otherwise("none")
    return j.select("ts", rounded(F.coalesce("naive_d7", "naive_d1", F.lit(0.0))).alias("baseline"), source.alias("source"))


@query("G13_sparse_linear")
def g13(spark, d):
    """One cross-validated lasso for every slot of every delivery day, with its penalty, intercept and coefficients."""
    x = dataset(spark, d).withColumn("mtu", T.mtu(F.col("ts")))
    f = M.lasso_by_slot(settle(x), "day", 14, 300, "mtu", FEATURES, "y")
    coefficients = [rounded(F.col("coefficients")[i], 4).alias(f"coef_{n}") for i, n in enumerate(FEATURES)]
    return f.select("fold", "mtu", "id", rounded(F.col("y_pred"), 4).alias("y_pred"), rounded(F.col("alpha")).alias("alpha"), rounded(F.col("intercept")).alias("intercept"), *coefficients)


def ridge_forecast(spark, d):
    """fold, id, y_pred of the rolling ridge, and its models, one row a day with the seconds that it took."""
    rows = settle(dataset(spark, d))
    models = settle(R.fit_windows(rows, FEATURES, "y", 14, 300))
    return R.predict_windows(rows, models, FEATURES).select(F.col("day").alias("fold"), "id", "y_pred"), models


def rolling_forecast(spark, d):
    """fold, id, ts, model, y_pred, y_true of the ridge and of the naive benchmark on its days; day, seconds of each fit."""
    fit, models = ridge_forecast(spark, d)
    fit = settle(fit)
    truth = series(spark, d).select("ts", T.seconds(F.col("ts")).alias("id"), F.col("v").alias("y_true"))
    own = ["fold", "id", "ts", "model", "y_pred", "y_true"]
    model = fit.withColumn("model", F.lit("ridge")).join(truth, "id").select(*own)
    naive = panel(spark, d).where("model = 'naive_d1'").withColumn("id", T.seconds(F.col("ts")))
    return model.unionByName(naive.join(fit.select("fold", "id"), "id").select(*own)), models.select("day", "seconds")


@query("G18_rolling_forecast")
def g18(spark, d):
    """Rolling-origin forecast: metrics of the model and of the naive benchmark on its days, full and for each delivery day."""
    both, _ = rolling_forecast(spark, d)
    days = both.groupBy("model", "fold").agg(F.count("y_pred").alias("n"), F.avg(F.abs(E.errors())).alias("mae"))  # what a run writes for each day
    full = E.point_metrics(both, ["model"]).withColumn("fold", F.lit(None).cast("date"))
    rows = days.select("model", "fold", "mae", F.lit(None).cast("double").alias("rmse"), F.lit(None).cast("double").alias("bias"), F.col("n").alias("n_obs"))
    return out(full.select("model", "fold", "mae", "rmse", "bias", "n_obs").unionByName(rows), ["model", "fold"], "mae", "rmse", "bias", "n_obs")


@query("G18_forecast_bundle")
def g18_bundle(spark, d):
    """The rolling forecast written as a bundle (forecast by month, measured seconds of each delivery day's fit, metrics, configuration) and read back by day."""
    both, runtime = rolling_forecast(spark, d)
    both = settle(both)
    metrics = E.monthly_metrics(both).withColumnRenamed("month", "period")
    forecast = both.withColumn("month", F.date_format(T.local(F.col("ts")), "yyyy-MM"))
    b = write_bundle(forecast, runtime, metrics, {"experiment": "ridge", "window": 14, "features": FEATURES}, shared_folder(spark))
    rows = b["forecast"].where("model = 'ridge'").groupBy(F.col("fold").alias("day")).agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg("y_pred"), 4).alias("mean_pred"))
    full = b["metrics"].where("model = 'ridge' AND period = 'full'").select(rounded(F.col("mae")).alias("mae"))
    found = rows.join(b["runtime"], "day").crossJoin(F.broadcast(full)).crossJoin(F.broadcast(b["config"].select("experiment")))  # one row each
    return found.select("day", "rows", "mean_pred", (F.col("seconds") > 0).alias("timed"), "mae", "experiment")


@query("G23_one_day_prediction")
def g23(spark, d):
    """The delivery day after the last one: features without truth, one fold."""
    x = dataset(spark, d)
    last = x.agg(F.max("day").alias("fold"))
    one = x.join(F.broadcast(last)).withColumn("split", F.when(F.col("day") == F.col("fold"), "test").otherwise("train"))
    one = one.where(F.col("day") >= F.date_sub(F.col("fold"), 14)).withColumn("y", F.when(F.col("split") == "train", F.col("y")))
    return out(M.ridge_by_fold(one, FEATURES, "y"), ["fold", "id"], "y_pred")


# The same recursion over days in SQL: each key carries its corrected errors of the last 7 days.
_WALK = f"""RECURSIVE {PANEL}, {_H}, daily AS (SELECT model, hour, day, sum(y_pred - y_true) AS e, count(*)::DOUBLE AS n FROM h GROUP BY 1, 2, 3),
walk AS (SELECT model, hour, min(day) - 1 AS day, max(day) AS last, 0::DOUBLE AS bias, CAST([] AS STRUCT(d DATE, e DOUBLE, n DOUBLE)[]) AS hist FROM daily GROUP BY 1, 2
  UNION ALL SELECT model, hour, day, last, bias, CASE WHEN n IS NULL THEN hist ELSE list_append(hist, {{'d': day, 'e': e - n * bias, 'n': n}}) END AS hist
  FROM (SELECT *, CASE WHEN list_sum(list_transform(hist, lambda x: x.n)) >= 8 THEN 0.5 * list_sum(list_transform(hist, lambda x: x.e)) / list_sum(list_transform(hist, lambda x: x.n)) ELSE 0 END AS bias
    FROM (SELECT w.model, w.hour, w.day + 1 AS day, w.last, d.e, d.n, list_filter(w.hist, lambda x: x.d >= w.day - 6) AS hist FROM walk w LEFT JOIN daily d ON d.model = w.model AND d.hour = w.hour AND d.day = w.day + 1 WHERE w.day < w.last))),
fixed AS (SELECT h.ts, h.model, h.day, h.hour, h.y_true, h.y_pred, coalesce(w.bias, 0) AS bias FROM h LEFT JOIN walk w USING (model, hour, day))"""


@query("H2_recursive_bias", f"WITH {_WALK} SELECT ts, model, round(bias, 6) AS bias, round(y_pred - bias, 6) AS y_corrected FROM fixed")
def h2(spark, d):
    p = hourly_panel(spark, d)
    b = RC.recursive_bias(p, ["model", "hour"], 7, 8, 0.5)
    return p.join(b, ["model", "hour", "day"], "left").select("ts", "model", rounded(F.coalesce("bias", F.lit(0.0))).alias("bias"), rounded(F.col("y_pred") - F.coalesce("bias", F.lit(0.0))).alias("y_corrected"))


_BINNED = """bn AS (SELECT h.*, CASE WHEN y_pred <= 60 THEN 0 WHEN y_pred <= 120 THEN 1 ELSE 2 END AS bin FROM h)"""


@query("H4_binned_quantiles", f"""WITH {PANEL}, {_H}, {_BINNED},
g AS (SELECT a.model, a.day, a.bin, count(*) AS n, quantile_cont(b.y_true - b.y_pred, 0.1) AS q1, quantile_cont(b.y_true - b.y_pred, 0.5) AS q5, quantile_cont(b.y_true - b.y_pred, 0.9) AS q9 FROM (SELECT DISTINCT model, day, bin FROM bn) a JOIN bn b ON b.model = a.model AND b.bin = a.bin AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2, 3),
w AS (SELECT a.model, a.day, count(*) AS n, quantile_cont(b.y_true - b.y_pred, 0.1) AS q1, quantile_cont(b.y_true - b.y_pred, 0.5) AS q5, quantile_cont(b.y_true - b.y_pred, 0.9) AS q9 FROM (SELECT DISTINCT model, day FROM bn) a JOIN bn b ON b.model = a.model AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2),
j AS (SELECT h.ts, h.model, y_pred, CASE WHEN g.n >= 50 THEN g.q1 WHEN w.n >= 50 THEN w.q1 END AS q1, CASE WHEN g.n >= 50 THEN g.q9 WHEN w.n >= 50 THEN w.q9 END AS q9 FROM bn h LEFT JOIN g USING (model, day, bin) LEFT JOIN w ON w.model = h.model AND w.day = h.day)
SELECT ts, model, round(greatest(0, y_pred + q1), 5) AS q10, round(greatest(0, y_pred + q9), 5) AS q90 FROM j WHERE q1 IS NOT NULL""")
def h4(spark, d):
    p = hourly_panel(spark, d).withColumn("bin", F.when(F.col("y_pred") <= 60, 0).when(F.col("y_pred") <= 120, 1).otherwise(2))
    q = C.residual_quantiles(p, ["model"], "bin", [0.1, 0.5, 0.9], 7, 50)
    at = lambda t: rounded(F.max(F.when(F.col("tau") == t, F.col("q"))), 5)
    return q.groupBy("ts", "model").agg(at(0.1).alias("q10"), at(0.9).alias("q90"))


@query("H6_grouped_correction", f"""WITH {PANEL}, {_H}, wk AS (SELECT *, CASE WHEN (dayofweek(day) + 6) % 7 >= 5 THEN 'off' ELSE 'work' END AS kind FROM h),
g AS (SELECT a.model, a.day, a.kind, avg(b.y_pred - b.y_true) AS g, count(DISTINCT b.day) AS n FROM (SELECT DISTINCT model, day, kind FROM wk) a JOIN wk b ON b.model = a.model AND b.kind = a.kind AND b.day BETWEEN a.day - 14 AND a.day - 1 GROUP BY 1, 2, 3),
w AS (SELECT a.model, a.day, avg(b.y_pred - b.y_true) AS g, count(DISTINCT b.day) AS n FROM (SELECT DISTINCT model, day FROM wk) a JOIN wk b ON b.model = a.model AND b.day BETWEEN a.day - 14 AND a.day - 1 GROUP BY 1, 2)
SELECT h.ts, h.model, round(y_pred - 0.5 * coalesce(CASE WHEN g.n >= 3 THEN g.g END, CASE WHEN w.n >= 3 THEN w.g END, 0) + 1e-9, 5) AS y_corrected FROM wk h LEFT JOIN g USING (model, day, kind) LEFT JOIN w ON w.model = h.model AND w.day = h.day""")
def h6(spark, d):
    p = hourly_panel(spark, d).withColumn("kind", F.when(F.weekday("day") >= 5, "off").otherwise("work"))
    b = C.rolling_bias(p, ["model"], "kind", 14, 3, 0.5)
    return b.select("ts", "model", N.rounded_up(F.col("y_corrected"), 5).alias("y_corrected"))


def calibrator_rows(spark, d):
    p = hourly_panel(spark, d).where("model = 'naive_d1'")
    s, c = N.cyclic(F.col("hour").cast("double"), 24.0)
    return p.select("ts", "day", T.seconds(F.col("ts")).alias("id"), "y_pred", s.alias("hour_sin"), c.alias("hour_cos"), (F.weekday("day") >= 5).cast("double").alias("weekend"), (F.col("y_true") - F.col("y_pred")).alias("residual"), "y_true")


@query("H7_point_calibrator")
def h7(spark, d):
    """Residual regressed on what is known at forecast time; half of the prediction is added."""
    rows, x = calibrator_rows(spark, d).withColumnRenamed("y_pred", "y_raw"), ["y_raw", "hour_sin", "hour_cos", "weekend"]
    fit = R.predict_windows(rows, R.fit_windows(rows, x, "residual", 14, 60, 10.0), x)
    return fit.select("ts", rounded(F.greatest(F.col("y_raw") + 0.5 * F.col("y_pred"), F.lit(0.0))).alias("y_calibrated"), "y_true")


@query("H8_postprocess_chain", f"""WITH {_WALK}, c AS (SELECT ts, model, day, hour, y_true, greatest(y_pred - bias, 0) AS y_pred FROM fixed),
g AS (SELECT a.model, a.day, a.hour, count(*) AS n, [quantile_cont(b.y_true - b.y_pred, 0.1), quantile_cont(b.y_true - b.y_pred, 0.5), quantile_cont(b.y_true - b.y_pred, 0.9)] AS q FROM (SELECT DISTINCT model, day, hour FROM c) a JOIN c b ON b.model = a.model AND b.hour = a.hour AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2, 3),
k AS (SELECT a.model, a.day, count(*) AS n, [quantile_cont(b.y_true - b.y_pred, 0.1), quantile_cont(b.y_true - b.y_pred, 0.5), quantile_cont(b.y_true - b.y_pred, 0.9)] AS q FROM (SELECT DISTINCT model, day FROM c) a JOIN c b ON b.model = a.model AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2),
j AS (SELECT c.ts, c.model, c.y_pred, CASE WHEN g.n >= 12 THEN g.q WHEN k.n >= 12 THEN k.q END AS q FROM c LEFT JOIN g USING (model, day, hour) LEFT JOIN k ON k.model = c.model AND k.day = c.day)
SELECT ts, model, t.tau::DOUBLE AS tau, round(greatest(0, y_pred + q[t.i]), 6) AS q FROM j, (VALUES (1, 0.1), (2, 0.5), (3, 0.9)) t(i, tau) WHERE q IS NOT NULL""")
def h8(spark, d):
    """Recursive bias, then residual quantiles of the corrected series."""
    p = hourly_panel(spark, d)
    b = RC.recursive_bias(p, ["model", "hour"], 7, 8, 0.5)
    fixed = p.join(b, ["model", "hour", "day"], "left").withColumn("y_pred", F.greatest(F.col("y_pred") - F.coalesce("bias", F.lit(0.0)), F.lit(0.0))).drop("bias")
    q = C.residual_quantiles(fixed, ["model"], "hour", [0.1, 0.5, 0.9], 7, 12)
    return q.select("ts", "model", "tau", rounded(F.col("q")).alias("q"))


@query("H8_full_postprocess")
def h8_full(spark, d):
    """The whole chain on each series' own corrected history: grouped correction over bins, calibrator, quantiles, and the series' totals."""
    p = hourly_panel(spark, d).withColumn("mtu", T.mtu(F.col("ts"))).withColumn("kind", (F.weekday("day") >= 5).cast("int"))
    c = settle(RC.postprocess_days(p, ["model"]))
    total = RC.component_totals(c, "model", "total", 2).select("ts", "model", "y_pred")
    q = [F.col("quantiles")[i].alias(f"q{int(100 * t)}") for i, t in enumerate(RC.Postprocess().taus)]
    rows = c.select("ts", "model", "y_base", "y_pred", *q).unionByName(total, allowMissingColumns=True)
    return out(rows, ["ts", "model"], "y_base", "y_pred", "q10", "q50", "q90")


@query("H12_sequence_correction")
def h12(spark, d):
    """Whole-day trajectories of the gap-filled series and the ridge correction of their 96 residuals."""
    g = G.on_grid(series(spark, d), [])
    g = settle(g.withColumn("v", F.coalesce("v", F.lit(0.0))))
    p = L.naive(g, [1]).where("model = 'naive_d1'").withColumn("day", T.local_day(F.col("ts"))).withColumn("mtu", T.mtu(F.col("ts")))
    c = RC.sequence_correction(RC.day_sequences(p, ["model"]), ["model"], 14, 5)
    return c.select("model", "day", F.posexplode("correction").alias("mtu", "x")).select("model", "day", "mtu", rounded(F.col("x"), 4).alias("correction"))


@query("H14_proxy_baseline")
def h14(spark, d):
    """Ridge baseline from proxy columns, never negative, and the residual that a model fits."""
    x = settle(dataset(spark, d))
    fit = R.predict_windows(x, R.fit_windows(x, ["v_lag_1d", "v_lag_7d"], "y", 14, 300, 5.0), ["v_lag_1d", "v_lag_7d"])
    base = F.greatest(F.col("y_pred"), F.lit(0.0))
    return fit.select("ts", rounded(base).alias("baseline"), rounded(F.col("y") - base).alias("residual"))
