"""Fold, model, calibration and attribution queries (families G, H and I)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions import numeric as N
from ..functions.numeric import clean, clip, rounded
from ..operators import calibration as C
from ..operators import folds as M
from ..operators import lags as L
from ..operators import linear as R
from ..sources.files import settle
from .frames import AREAS, DAY, LOCAL, MTU, PANEL, SERIES, areas, out, panel, query, series, table

_AD = f"ad AS (SELECT area, {DAY} AS day, sum(v) AS v, count(*) AS n FROM areas GROUP BY 1, 2)"


def area_days(spark, d):
    return areas(spark, d).groupBy("area", T.local_day(F.col("ts")).alias("day")).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))


_FOLDS = f"{AREAS}, {_AD}, tr AS (SELECT f.day AS fold, 'train' AS split, r.area, r.day, r.v FROM (SELECT DISTINCT day FROM ad) f JOIN ad r ON r.day BETWEEN f.day - 7 AND f.day - 1), ok AS (SELECT fold FROM tr GROUP BY 1 HAVING count(*) >= 20), folds AS (SELECT * FROM tr WHERE fold IN (SELECT fold FROM ok) UNION ALL SELECT day, 'test', area, day, v FROM ad WHERE day IN (SELECT fold FROM ok))"


def folds(spark, d):
    return settle(M.rolling_folds(settle(area_days(spark, d).select("area", "day", "v")), "day", 7, 20))


@query("G1_rolling_folds", f"WITH {_FOLDS} SELECT fold, split, area, day, round(v, 4) AS v FROM folds")
def g1(spark, d):
    return folds(spark, d).select("fold", "split", "area", "day", rounded(F.col("v"), 4).alias("v"))


_ROB = "c AS (SELECT area, median(v) AS center, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM areas GROUP BY 1), m AS (SELECT area, any_value(center) AS center, any_value(iqr) AS iqr, median(abs(v - center)) AS mad FROM areas JOIN c USING (area) GROUP BY 1), rob AS (SELECT area, center, CASE WHEN mad > 0 THEN mad / 0.6745 WHEN iqr > 0 THEN iqr / 1.349 ELSE 1 END AS scale FROM m)"


@query("G2_robust_transform", f"WITH {AREAS}, {_ROB}, z AS (SELECT area, ts, asinh((v - center) / scale) AS z, center, scale FROM areas JOIN rob USING (area)) SELECT area, ts, round(z, 6) AS z, round(center + scale * sinh(z), 5) AS back FROM z")
def g2(spark, d):
    a = areas(spark, d)
    z = a.join(F.broadcast(M.robust_scale(a, ["area"], "v")), "area").withColumn("z", F.asinh((F.col("v") - F.col("center")) / F.col("scale")))
    return z.select("area", "ts", rounded(F.col("z")).alias("z"), rounded(F.col("center") + F.col("scale") * F.sinh("z"), 5).alias("back"))


@query("G2_smearing", f"""WITH {AREAS}, {_ROB}, z AS (SELECT area, ts, {DAY} AS day, {MTU} AS mtu, asinh((v - center) / scale) AS z, center, scale FROM areas JOIN rob USING (area)),
w AS (SELECT a.*, b.z AS x FROM z a JOIN z b ON b.area = a.area AND b.mtu = a.mtu AND b.day = a.day - 1),
t AS (SELECT f.area, f.day AS fold, w.x, w.z FROM (SELECT DISTINCT area, day FROM w) f JOIN w ON w.area = f.area AND w.day BETWEEN f.day - 7 AND f.day - 1),
mo AS (SELECT area, fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(z) AS mz, covar_pop(x, z) AS c, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 10),
b AS (SELECT *, n * c / sx / (n + 1) AS beta FROM mo), r AS (SELECT t.area, t.fold, t.z - mz - beta * (t.x - mx) / sx AS r FROM t JOIN b USING (area, fold)),
p AS (SELECT w.area, w.ts, w.day AS fold, w.center, w.scale, mz + beta * (w.x - mx) / sx AS y FROM w JOIN b ON b.area = w.area AND b.fold = w.day)
SELECT p.area, p.ts, round(any_value(center) + any_value(scale) * avg(sinh(p.y + r.r)) + 1e-9, 4) AS y_pred FROM p JOIN r ON r.area = p.area AND r.fold = p.fold GROUP BY p.area, p.ts""")
def g2_smearing(spark, d):
    """Forecasts of the transformed series brought back with the mean over the training residuals of each day's model."""
    a = areas(spark, d)
    z = a.join(F.broadcast(M.robust_scale(a, ["area"], "v")), "area").select("area", "ts", T.local_day(F.col("ts")).alias("day"), T.mtu(F.col("ts")).alias("mtu"), F.asinh((F.col("v") - F.col("center")) / F.col("scale")).alias("z"), "center", "scale")
    z = settle(z)
    rows = settle(z.join(z.select("area", F.date_add("day", 1).alias("day"), "mtu", F.col("z").alias("x")), ["area", "day", "mtu"]))
    models = settle(R.fit_windows(rows, ["x"], "z", 7, 10, keys=["area"]))
    p = R.predict_windows(rows, models, ["x"], ["area"]).join(R.residual_smear(rows, models, "x", "z", 7, ["area"]), ["area", "day"])
    y = R.smeared(F.col("y_pred"), F.col("mean_sinh"), F.col("mean_cosh"), F.col("center"), F.col("scale"))
    return p.select("area", "ts", N.rounded_up(y, 4).alias("y_pred"))


@query("G3_fold_scaling", f"WITH {_FOLDS}, s AS (SELECT fold, area, min(v) AS lo, max(v) AS hi FROM folds WHERE split = 'train' GROUP BY 1, 2) SELECT fold, split, area, day, round(CASE WHEN hi - lo > 1e-9 THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM folds JOIN s USING (fold, area)")
def g3(spark, d):
    return out(M.minmax_scale(folds(spark, d), ["fold", "area"], "v"), ["fold", "split", "area", "day"], "scaled")


@query("G5_select_features", f"""WITH {PANEL}, f AS (SELECT p.ts, p.y_true, u.name, u.x FROM (SELECT ts, y_true, y_pred, hour({LOCAL}) AS h FROM panel WHERE model = 'naive_d1') p,
 (VALUES ('a'), ('b'), ('c'), ('d')) n(k), LATERAL (SELECT CASE n.k WHEN 'a' THEN 'lag' WHEN 'b' THEN 'hour' WHEN 'c' THEN 'mix' ELSE 'flat' END AS name, CASE n.k WHEN 'a' THEN p.y_pred WHEN 'b' THEN p.h WHEN 'c' THEN p.y_pred + 10 * p.h ELSE 1 END::DOUBLE AS x) u),
r AS (SELECT name, corr(x, y_true) AS r, min(x) AS lo, max(x) AS hi FROM f GROUP BY 1)
SELECT name, round(r, 6) AS r, row_number() OVER (ORDER BY abs(r) DESC, name)::INTEGER AS rank FROM r WHERE hi > lo QUALIFY row_number() OVER (ORDER BY abs(r) DESC, name) <= 2""")
def g5(spark, d):
    p = panel(spark, d).where("model = 'naive_d1'").withColumn("h", F.hour(T.local(F.col("ts"))).cast("double"))
    x = F.create_map(F.lit("lag"), F.col("y_pred"), F.lit("hour"), F.col("h"), F.lit("mix"), F.col("y_pred") + 10 * F.col("h"), F.lit("flat"), F.lit(1.0))
    long = p.select("y_true", F.explode(x).alias("name", "x"))
    return out(M.top_correlated(long, [], "name", "x", "y_true", 2), ["name"], "r", "rank")


@query("G6_training_mask", f"WITH {PANEL}, q AS (SELECT model, quantile_cont(y_pred, 0.75) AS hi FROM panel GROUP BY 1) SELECT ts, model, hour({LOCAL}) BETWEEN 6 AND 20 AND NOT (y_pred >= hi AND y_true / y_pred < 0.2) AS keep FROM panel JOIN q USING (model)")
def g6(spark, d):
    p = panel(spark, d)
    q = p.groupBy("model").agg(F.percentile("y_pred", F.lit(0.75)).alias("hi"))
    suspicious = (F.col("y_pred") >= F.col("hi")) & (F.col("y_true") / F.col("y_pred") < 0.2)
    return p.join(F.broadcast(q), "model").select("ts", "model", (F.hour(T.local(F.col("ts"))).between(6, 20) & ~suspicious).alias("keep"))


@query("G7_recency_weight", f"WITH {_FOLDS}, w AS (SELECT fold, area, day, pow(0.5, (fold - day) / 3.0::DOUBLE) AS w FROM folds WHERE split = 'train') SELECT fold, area, day, round(w / avg(w) OVER (PARTITION BY fold), 6) AS weight FROM w")
def g7(spark, d):
    f = folds(spark, d).where("split = 'train'")
    return f.select("fold", "area", "day", rounded(M.recency_weight(F.datediff("fold", "day"), 3.0, ["fold"])).alias("weight"))


@query("G8_target_bounds", f"WITH {_FOLDS}, b AS (SELECT fold, area, max(v) AS top FROM folds WHERE split = 'train' GROUP BY 1, 2) SELECT f.fold, f.area, round(f.v / b.top, 6) AS capacity_factor, round(greatest(0, least(1.05 * b.top, f.v * 1.2)), 5) AS bounded FROM folds f JOIN b USING (fold, area) WHERE f.split = 'test'")
def g8(spark, d):
    rows = settle(area_days(spark, d).select("area", "day", "v"))
    f = rows.withColumnRenamed("day", "fold").join(M.window_extremes(rows, ["area"], "day", "v", 7, 20), ["fold", "area"])
    return f.select("fold", "area", rounded(F.col("v") / F.col("hi")).alias("capacity_factor"), rounded(clip(F.col("v") * 1.2, 0.0, 1.05 * F.col("hi")), 5).alias("bounded"))


@query("G10_hour_blocks", f"WITH {PANEL}, b AS (SELECT model, CASE WHEN hour({LOCAL}) < 6 THEN '00-06' WHEN hour({LOCAL}) < 12 THEN '06-12' WHEN hour({LOCAL}) < 18 THEN '12-18' ELSE '18-24' END AS block, {DAY} AS day, y_pred - y_true AS e FROM panel) SELECT model, day, block, round(avg(e), 6) AS bias, count(*) AS n FROM b GROUP BY 1, 2, 3")
def g10(spark, d):
    h = F.hour(T.local(F.col("ts")))
    block = F.when(h < 6, "00-06").when(h < 12, "06-12").when(h < 18, "12-18").otherwise("18-24")
    return panel(spark, d).groupBy("model", T.local_day(F.col("ts")).alias("day"), block.alias("block")).agg(rounded(F.avg(F.col("y_pred") - F.col("y_true"))).alias("bias"), F.count(F.lit(1)).alias("n"))


@query("G11_regimes", f"WITH {PANEL}, r AS (SELECT model, ts, y_true, CASE WHEN y_pred >= 120 THEN 'clear' WHEN y_pred >= 60 THEN 'mixed' ELSE 'overcast' END AS regime FROM panel), c AS (SELECT model, regime, count(*) AS n, avg(y_true) AS m FROM r GROUP BY 1, 2), g AS (SELECT model, avg(y_true) AS m FROM r GROUP BY 1) SELECT r.model, r.ts, r.regime, c.n < 600 AS fallback, round(CASE WHEN c.n < 600 THEN g.m ELSE c.m END, 5) AS y_pred FROM r JOIN c USING (model, regime) JOIN g ON g.model = r.model")
def g11(spark, d):
    y = F.col("y_pred")
    r = panel(spark, d).withColumn("regime", F.when(y >= 120, "clear").when(y >= 60, "mixed").otherwise("overcast"))
    own = r.groupBy("model", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("m"))
    every = r.groupBy("model").agg(F.avg("y_true").alias("g"))
    j = r.join(F.broadcast(own), ["model", "regime"]).join(F.broadcast(every), "model")
    return j.select("model", "ts", "regime", (F.col("n") < 600).alias("fallback"), rounded(F.when(F.col("n") < 600, F.col("g")).otherwise(F.col("m")), 5).alias("y_pred"))


def wide_panel(spark, d):
    """ts, id, day, naive_d1, naive_d7, hour, y: the naive lags side by side, written."""
    p = panel(spark, d).groupBy("ts").agg(F.max("y_true").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in ("naive_d1", "naive_d7")])
    return settle(p.select("ts", T.seconds(F.col("ts")).alias("id"), T.local_day(F.col("ts")).alias("day"), "naive_d1", "naive_d7", F.hour(T.local(F.col("ts"))).cast("double").alias("hour"), "y"))


@query("G12_ridge_folds")
def g12(spark, d):
    """Ridge on the two naive lags and the clock, one fit per delivery day."""
    rows, x = wide_panel(spark, d), ["naive_d1", "naive_d7", "hour"]
    p = R.predict_windows(rows, R.fit_windows(rows, x, "y", 14, 200), x)
    return out(p.withColumnRenamed("day", "fold"), ["fold", "id"], "y_pred")


@query("G10_block_models")
def g10_models(spark, d):
    """A ridge for each block of six hours and day; a day counts only if all its blocks have their own model."""
    rows, x = wide_panel(spark, d).withColumn("block", F.floor(F.col("hour") / 6).cast("int")), ["naive_d1", "naive_d7", "hour"]
    models = R.fit_parts(rows, "block", x, "y", 14, 100, 20)
    whole = models.groupBy("day").agg(F.max(F.col("fallback").cast("int")).alias("_f")).where("_f = 0").select("day")
    return out(R.predict_windows(rows, models.join(whole, "day", "left_semi"), x, ["block"]), ["day", "id", "block"], "y_pred")


def regime_rows(spark, d):
    """The panel with weather regimes: the older lag's share stands for cloud cover, the lags' ratio for the irradiance's."""
    p = wide_panel(spark, d)
    cloud = 100 * N.safe_ratio(F.col("naive_d7"), F.col("naive_d1") + F.col("naive_d7"), 1e-6, None)
    ratio = clip(N.safe_ratio(F.col("naive_d1"), F.col("naive_d7"), 1e-6, None), 0.0, 2.0)
    return p.withColumn("regime", R.weather_regime(cloud, ratio))


_REGIME = f"""w AS (SELECT ts, {DAY} AS day, max(y_true) AS y, max(y_pred) FILTER (model = 'naive_d1') AS a, max(y_pred) FILTER (model = 'naive_d7') AS b FROM panel GROUP BY 1),
r AS (SELECT ts, day, CASE WHEN coalesce(CASE WHEN a + b > 1e-6 THEN 100 * b / (a + b) END <= 35, FALSE) AND coalesce(CASE WHEN b > 1e-6 THEN least(a / b, 2) END >= 0.65, FALSE) THEN 'clear'
  WHEN coalesce(CASE WHEN a + b > 1e-6 THEN 100 * b / (a + b) END >= 80, FALSE) OR coalesce(CASE WHEN b > 1e-6 THEN least(a / b, 2) END <= 0.35, FALSE) THEN 'overcast' ELSE 'mixed' END AS regime FROM w)"""


@query("G11_regime_split", f"""WITH {PANEL}, {_REGIME}, k AS (SELECT DISTINCT day, regime FROM r), f AS (SELECT d.day FROM (SELECT DISTINCT day FROM r) d JOIN r ON r.day BETWEEN d.day - 14 AND d.day - 1 GROUP BY 1 HAVING count(*) >= 100),
n AS (SELECT k.day, k.regime, count(r.ts) AS n_part FROM k LEFT JOIN r ON r.regime = k.regime AND r.day BETWEEN k.day - 14 AND k.day - 1 GROUP BY 1, 2)
SELECT r.ts, r.regime, n_part, n_part < 200 AS fallback FROM r JOIN n USING (day, regime) JOIN f USING (day)""")
def g11_split(spark, d):
    """Which model serves a row: its regime's own, or that of all rows where the window has too few of the regime."""
    rows = regime_rows(spark, d)
    models = R.fit_parts(rows, "regime", ["naive_d1", "naive_d7", "hour"], "y", 14, 100, 200)
    return rows.join(models, ["day", "regime"]).select("ts", "regime", "n_part", "fallback")


@query("G11_regime_models")
def g11_models(spark, d):
    """A ridge for each weather regime and day; regimes with few rows share the day's model of all rows."""
    rows, x = regime_rows(spark, d), ["naive_d1", "naive_d7", "hour"]
    return out(R.predict_windows(rows, R.fit_parts(rows, "regime", x, "y", 14, 100, 200), x, ["regime"]), ["ts", "day", "regime"], "y_pred")


@query("G14_boosted_trees")
def g14(spark, d):
    """Boosted trees refitted for every delivery day in three configurations: one model a day, one a block of six hours, one a slot."""
    p = L.naive(series(spark, d), [1]).withColumn("mtu", T.mtu(F.col("ts"))).withColumn("day", T.local_day(F.col("ts")))
    rows = settle(p.select(T.seconds(F.col("ts")).alias("id"), "day", "mtu", F.floor(F.col("mtu") / 24).cast("int").alias("block"), F.weekday("day").alias("dow"), F.col("y_pred").alias("lag"), F.col("y_true").alias("y")))
    parts = {"day": ([], ["lag", "mtu", "dow"]), "block": (["block"], ["lag", "mtu", "dow"]), "slot": (["mtu"], ["lag", "dow"])}
    return out(M.boosted_by_fold(rows, "day", 14, 100, parts, "y"), ["configuration", "fold", "id"], "y_pred")


@query("G15_components")
def g15(spark, d):
    """Principal components of the embedding vectors after standardisation."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(e).transform(e)
    pc = vector_to_array("pc")
    return PCA(k=2, inputCol="x", outputCol="pc").fit(scaled).transform(scaled).select("vec_id", F.round(F.abs(pc[0]), 4).alias("pc1"), F.round(F.abs(pc[1]), 4).alias("pc2"))


@query("G16_bounded_sample", f"""WITH {SERIES}, n AS (SELECT ts, (dayofweek({LOCAL}) + 6) % 7 AS dow, row_number() OVER (ORDER BY ts DESC) AS back, (dayofweek(max({LOCAL}) OVER () + INTERVAL 1 DAY) + 6) % 7 AS asked FROM series),
a AS (SELECT *, back <= 192 AS recent, CASE WHEN back > 192 AND dow = asked THEN row_number() OVER (PARTITION BY back > 192, dow = asked ORDER BY ts DESC) END AS k FROM n),
b AS (SELECT *, coalesce(k <= 192, FALSE) AS same FROM a), c AS (SELECT *, CASE WHEN NOT recent AND NOT same THEN row_number() OVER (PARTITION BY recent OR same ORDER BY ts) - 1 END AS i, count(*) FILTER (NOT recent AND NOT same) OVER () AS m FROM b)
SELECT ts, CASE WHEN recent THEN 'recent' WHEN same THEN 'weekday' ELSE 'older' END AS part FROM c
WHERE recent OR same OR m <= 96 OR i IN (SELECT round(j * ((SELECT max(m) FROM c) - 1) / 95.0::DOUBLE)::BIGINT FROM range(96) t(j))""")
def g16(spark, d):
    """The training context for the day after the last: recent rows, the latest of its weekday, evenly spaced older ones."""
    s = series(spark, d)
    day = s.agg(F.weekday(F.date_add(F.max(T.local_day(F.col("ts"))), 1)).alias("asked"))
    rows = s.crossJoin(F.broadcast(day)).select("ts", (F.weekday(T.local(F.col("ts"))) == F.col("asked")).alias("same"))  # one row
    return M.bounded_context(rows, [], "ts", "same", 192, 192, 96)


@query("G17_clean_impute", "WITH x AS (SELECT event_id, event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS v FROM events), m AS (SELECT event_type, median(v) AS m FROM x GROUP BY 1) SELECT event_id, round(coalesce(v, m), 6) AS v FROM x JOIN m USING (event_type)")
def g17(spark, d):
    x = table(spark, d, "events").select("event_id", "event_type", clean(F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))).alias("v"))
    m = x.groupBy("event_type").agg(F.median("v").alias("m"))
    return x.join(F.broadcast(m), "event_type").select("event_id", rounded(F.coalesce("v", "m")).alias("v"))


@query("G19_component_totals", f"WITH {AREAS}, w AS (SELECT ts, max(v) FILTER (area = 'click') AS a, max(v) FILTER (area = 'view') AS b, max(v) FILTER (area = 'error') AS c FROM areas GROUP BY ts) SELECT ts, round(a + b, 6) AS wind, round(CASE WHEN hour({LOCAL}) < 6 THEN 0 ELSE c END, 6) AS solar, round(a + b + CASE WHEN hour({LOCAL}) < 6 THEN 0 ELSE c END, 6) AS total FROM w")
def g19(spark, d):
    w = areas(spark, d).groupBy("ts").pivot("area", ["click", "view", "error"]).agg(F.max("v"))
    wind, solar = F.col("click") + F.col("view"), F.when(F.hour(T.local(F.col("ts"))) < 6, 0.0).otherwise(F.col("error"))
    return w.select("ts", rounded(wind).alias("wind"), rounded(solar).alias("solar"), rounded(wind + solar).alias("total"))


_SWEEP = {"days": (28, 42, 56, 70), "leaves": (15, 31, 63), "rounds": (100, 300), "rate": (0.03, 0.05, 0.1), "l2": (0.0, 1.0, 5.0), "clusters": (1, 2, 5, 8, 12, 16)}


@query("G20_sweep", "WITH " + ", ".join(f"{k} AS (SELECT * FROM (VALUES {', '.join(f'({x})' for x in v)}) t({k}))" for k, v in _SWEEP.items()) + ", e AS (SELECT DISTINCT event_type AS target FROM events) SELECT target, days, leaves, rounds, rate::DOUBLE AS rate, l2::DOUBLE AS l2, clusters FROM e, " + ", ".join(_SWEEP))
def g20(spark, d):
    """Every combination of the sweep's axes for every target of the data."""
    grid = table(spark, d, "events").select(F.col("event_type").alias("target")).distinct()
    for name, values in _SWEEP.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid


# Ridge with two standardised features, penalty 1, over the window before each day, in closed form.
_PAIR = """SELECT {0}, n, m1, m2, s1, s2, my, ((n + {1}) * n * c1 / s1 - n * c12 / (s1 * s2) * n * c2 / s2) / ((n + {1}) * (n + {1}) - pow(n * c12 / (s1 * s2), 2)) AS b1,
  ((n + {1}) * n * c2 / s2 - n * c12 / (s1 * s2) * n * c1 / s1) / ((n + {1}) * (n + {1}) - pow(n * c12 / (s1 * s2), 2)) AS b2"""
_SUMS = "count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, avg(y) AS my, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2"
_SETTINGS = {"window": [7, 14], "alpha": [0.5, 5.0, 50.0]}


@query("G20_sweep_scores", f"""WITH {AREAS}, loc AS (SELECT area, ts, {DAY} AS day, {MTU} AS mtu, v FROM areas), wide AS (SELECT a.area, a.day, a.v AS y, b.v AS x1, c.v AS x2 FROM loc a JOIN loc b ON b.area = a.area AND b.mtu = a.mtu AND b.day = a.day - 1 JOIN loc c ON c.area = a.area AND c.mtu = a.mtu AND c.day = a.day - 7),
mom AS (SELECT f.area, f.day, s.w, {_SUMS} FROM (SELECT DISTINCT area, day FROM wide) f CROSS JOIN (VALUES (7), (14)) s(w) JOIN wide v ON v.area = f.area AND v.day BETWEEN f.day - s.w::INTEGER AND f.day - 1 GROUP BY 1, 2, 3 HAVING count(*) >= 10),
fit AS ({_PAIR.format('area, day, w, a', 'a')} FROM mom CROSS JOIN (VALUES (0.5), (5.0), (50.0)) p(a)),
ok AS (SELECT area, day FROM fit GROUP BY 1, 2 HAVING count(*) = 6),
e AS (SELECT f.area, f.w, f.a, avg(abs(my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2 - y)) AS mae, count(*) AS n FROM wide v JOIN fit f USING (area, day) JOIN ok USING (area, day) GROUP BY 1, 2, 3)
SELECT area, w AS "window", a::DOUBLE AS alpha, round(mae + 1e-9, 4) AS mae, n, row_number() OVER (PARTITION BY area ORDER BY round(mae, 9), w, a)::INTEGER AS rank FROM e""")
def g20_scores(spark, d):
    """Every setting of the sweep scored for every area by one job; rank 1 is an area's best."""
    a = areas(spark, d).select("area", "ts", T.local_day(F.col("ts")).alias("day"), T.mtu(F.col("ts")).alias("mtu"), "v")
    lag = lambda n, name: a.select("area", F.date_add("day", n).alias("day"), "mtu", F.col("v").alias(name))
    rows = settle(a.withColumnRenamed("v", "y").join(lag(1, "x1"), ["area", "day", "mtu"]).join(lag(7, "x2"), ["area", "day", "mtu"]))
    s = R.score_settings(rows, ["x1", "x2"], "y", _SETTINGS["window"], _SETTINGS["alpha"], 10, ["area"])
    return s.select("area", "window", "alpha", N.rounded_up(F.col("mae"), 4).alias("mae"), "n", "rank")


@query("G22_benchmark_frame", f"WITH {PANEL} SELECT s.ts, round(p.y_pred, 6) AS benchmark, round(s.v, 6) AS actual FROM series s LEFT JOIN panel p ON p.ts = s.ts AND p.model = 'naive_d7'")
def g22(spark, d):
    p = panel(spark, d).where("model = 'naive_d7'").select("ts", F.col("y_pred").alias("benchmark"))
    return out(series(spark, d).withColumnRenamed("v", "actual").join(p, "ts", "left"), ["ts"], "benchmark", "actual")


_H = f"h AS (SELECT ts, model, {DAY} AS day, hour({LOCAL})::INTEGER AS hour, y_pred, y_true FROM panel)"


def hourly_panel(spark, d):
    """The panel with local day and hour, written, as its users read it several times."""
    return settle(panel(spark, d).withColumn("day", T.local_day(F.col("ts"))).withColumn("hour", F.hour(T.local(F.col("ts")))))


@query("H1_rolling_bias", f"""WITH {PANEL}, {_H}, g AS (SELECT a.model, a.day, a.hour, avg(b.y_pred - b.y_true) AS g, count(DISTINCT b.day) AS n FROM (SELECT DISTINCT model, day, hour FROM h) a JOIN h b ON b.model = a.model AND b.hour = a.hour AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2, 3),
w AS (SELECT a.model, a.day, avg(b.y_pred - b.y_true) AS g, count(DISTINCT b.day) AS n FROM (SELECT DISTINCT model, day FROM h) a JOIN h b ON b.model = a.model AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2)
SELECT h.ts, h.model, round(coalesce(CASE WHEN g.n >= 5 THEN g.g END, CASE WHEN w.n >= 5 THEN w.g END, 0) + 1e-9, 5) AS bias, round(y_pred - coalesce(CASE WHEN g.n >= 5 THEN g.g END, CASE WHEN w.n >= 5 THEN w.g END, 0) + 1e-9, 5) AS y_corrected
FROM h LEFT JOIN g USING (model, day, hour) LEFT JOIN w ON w.model = h.model AND w.day = h.day""")
def h1(spark, d):
    b = C.rolling_bias(hourly_panel(spark, d), ["model"], "hour", 7, 5)
    return b.select("ts", "model", N.rounded_up(F.col("bias"), 5).alias("bias"), N.rounded_up(F.col("y_corrected"), 5).alias("y_corrected"))


_HQ = "(SELECT quantile_cont(b.y_true - b.y_pred, {0}) FROM h b WHERE b.model = k.model AND b.day BETWEEN k.day - 7 AND k.day - 1{1})"


@query("H3_residual_quantiles", f"""WITH {PANEL}, {_H},
g AS (SELECT a.model, a.day, a.hour, count(*) AS n, quantile_cont(b.y_true - b.y_pred, 0.1) AS q1, quantile_cont(b.y_true - b.y_pred, 0.5) AS q5, quantile_cont(b.y_true - b.y_pred, 0.9) AS q9 FROM (SELECT DISTINCT model, day, hour FROM h) a JOIN h b ON b.model = a.model AND b.hour = a.hour AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2, 3),
w AS (SELECT a.model, a.day, count(*) AS n, quantile_cont(b.y_true - b.y_pred, 0.1) AS q1, quantile_cont(b.y_true - b.y_pred, 0.5) AS q5, quantile_cont(b.y_true - b.y_pred, 0.9) AS q9 FROM (SELECT DISTINCT model, day FROM h) a JOIN h b ON b.model = a.model AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2),
j AS (SELECT h.ts, h.model, y_pred, CASE WHEN g.n >= 12 THEN g.q1 WHEN w.n >= 12 THEN w.q1 END AS q1, CASE WHEN g.n >= 12 THEN g.q5 WHEN w.n >= 12 THEN w.q5 END AS q5, CASE WHEN g.n >= 12 THEN g.q9 WHEN w.n >= 12 THEN w.q9 END AS q9 FROM h LEFT JOIN g USING (model, day, hour) LEFT JOIN w ON w.model = h.model AND w.day = h.day)
SELECT ts, model, round(greatest(0, y_pred + q1), 5) AS q10, round(greatest(0, y_pred + q5), 5) AS q50, round(greatest(0, y_pred + q9), 5) AS q90 FROM j WHERE q1 IS NOT NULL""")
def h3(spark, d):
    q = C.residual_quantiles(hourly_panel(spark, d), ["model"], "hour", [0.1, 0.5, 0.9], 7, 12)
    at = lambda t: rounded(F.max(F.when(F.col("tau") == t, F.col("q"))), 5)
    return q.groupBy("ts", "model").agg(at(0.1).alias("q10"), at(0.5).alias("q50"), at(0.9).alias("q90"))


@query("H5_prediction_bins", f"""WITH {PANEL}, e AS (SELECT model, list_distinct([quantile_cont(y_pred, 0.25), quantile_cont(y_pred, 0.5), quantile_cont(y_pred, 0.75)]) AS e FROM panel GROUP BY 1)
SELECT ts, model, len(list_filter(e, lambda x: x < y_pred))::INTEGER AS bin, concat_ws('|', len(list_filter(e, lambda x: x < y_pred)), CASE WHEN (dayofweek({LOCAL}) + 6) % 7 >= 5 THEN 'off' ELSE 'work' END) AS "group" FROM panel JOIN e USING (model)""")
def h5(spark, d):
    p = panel(spark, d)
    edges = p.groupBy("model").agg(F.percentile("y_pred", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    b = C.bins(F.col("e"), F.col("y_pred"))
    kind = F.when(F.weekday(T.local(F.col("ts"))) >= 5, "off").otherwise("work")
    return p.join(F.broadcast(edges), "model").select("ts", "model", b.alias("bin"), F.concat_ws("|", b.cast("string"), kind).alias("group"))


@query("H9_point_ensemble", f"WITH {PANEL} SELECT ts, round(avg(y_pred), 6) AS mean, round(median(y_pred), 6) AS median, round(sum(y_pred * CASE model WHEN 'naive_d1' THEN 3 ELSE 1 END) / 4, 6) AS weighted, max(y_true) - min(y_true) <= 1e-6 AS consistent FROM panel GROUP BY ts HAVING count(DISTINCT model) = 2")
def h9(spark, d):
    return out(C.ensemble(panel(spark, d), ["ts"], {"naive_d1": 3.0}), ["ts"], "mean", "median", "weighted", "consistent")


@query("H10_component_sum", f"WITH {AREAS}, s AS (SELECT ts, sum(v) AS total, count(*) AS n FROM areas WHERE area <> 'signup' GROUP BY ts) SELECT s.ts, round(s.total, 4) AS total, round(a.v - s.total, 4) AS residual FROM s JOIN ({SERIES.split(' AS ', 1)[1]}) a ON a.ts = s.ts WHERE n >= 2")
def h10(spark, d):
    s = areas(spark, d).where("area <> 'signup'").groupBy("ts").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return s.join(series(spark, d), "ts").select("ts", rounded(F.col("total"), 4).alias("total"), rounded(F.col("v") - F.col("total"), 4).alias("residual"))


def stack_rows(spark, d):
    """area, ts, day, p1, p7, y: the areas' forecasts by two providers, of which each may be missing."""
    a = areas(spark, d).where("area IN ('click', 'view')").select("area", "ts", T.local_day(F.col("ts")).alias("day"), T.mtu(F.col("ts")).alias("mtu"), "v")
    lag = lambda n, name: a.select("area", F.date_add("day", n).alias("day"), "mtu", F.col("v").alias(name))
    both = a.withColumnRenamed("v", "y").join(lag(1, "p1"), ["area", "day", "mtu"], "left").join(lag(7, "p7"), ["area", "day", "mtu"], "left")
    return settle(both.where("p1 IS NOT NULL OR p7 IS NOT NULL").select("area", "ts", "day", "p1", "p7", "y"))


@query("H11_stack_ridge")
def h11_ridge(spark, d):
    """Rolling ridge over the providers of each area, the providers' mean where it cannot be fitted, and the areas' total where all are there."""
    s = R.stack(stack_rows(spark, d), ["p1", "p7"], "y", 14, 100, keys=["area"])
    total = s.groupBy("ts").agg(F.lit("total").alias("area"), F.sum("y_pred").alias("y_pred"), F.min(F.col("fitted").cast("int")).cast("boolean").alias("fitted"), F.count("y_pred").alias("_n")).where("_n = 2")
    rows = s.select("ts", "area", "y_pred", "fitted").unionByName(total.select("ts", "area", "y_pred", "fitted"))
    return out(rows, ["ts", "area"], "y_pred", "fitted")


@query("H11_stack_average", f"WITH {AREAS}, a AS (SELECT ts, v FROM areas WHERE area = 'click'), b AS (SELECT ts, v FROM areas WHERE area = 'view') SELECT ts, round((coalesce(a.v, 0) + coalesce(b.v, 0)) / ((a.v IS NOT NULL)::INT + (b.v IS NOT NULL)::INT), 6) AS y_pred FROM a FULL JOIN b USING (ts)")
def h11(spark, d):
    a = areas(spark, d)
    x, y = (a.where(F.col("area") == k).select("ts", F.col("v").alias(k)) for k in ("click", "view"))
    j = x.join(y, "ts", "full_outer")
    have = F.col("click").isNotNull().cast("int") + F.col("view").isNotNull().cast("int")
    return j.select("ts", rounded((F.coalesce("click", F.lit(0.0)) + F.coalesce("view", F.lit(0.0))) / have).alias("y_pred"))


@query("H13_nowcast_factor", f"""WITH {PANEL}, {_H}, k AS (SELECT DISTINCT model, day FROM h), g AS (SELECT k.model, k.day, sum(b.y_true) AS a, sum(b.y_pred) AS b, count(b.ts) AS n FROM k LEFT JOIN h b ON b.model = k.model AND b.day BETWEEN k.day - 5 AND k.day - 1 AND b.y_pred > 50 GROUP BY 1, 2),
f AS (SELECT model, day, CASE WHEN n >= 150 THEN greatest(0.7, least(1.3, 1 + 0.5 * (a / b - 1))) END AS x FROM g) SELECT model, day, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY model ORDER BY day ROWS UNBOUNDED PRECEDING), 1), 6) AS factor FROM f""")
def h13(spark, d):
    p = hourly_panel(spark, d).select("model", "day", F.when(F.col("y_pred") > 50, F.col("y_pred")).alias("baseline"), "y_true")
    return out(C.nowcast_factor(p, ["model"], 5, 150, 0.7, 1.3, 0.5), ["model", "day"], "factor")


_CONTRIB = f"""wide AS (SELECT a.ts, (a.ts + INTERVAL 1 HOUR)::DATE AS day, a.y_true AS y, a.y_pred AS x1, b.y_pred AS x2 FROM panel a JOIN panel b ON b.ts = a.ts AND b.model = 'naive_d7' WHERE a.model = 'naive_d1'),
mom AS (SELECT f.day, {_SUMS} FROM (SELECT DISTINCT day FROM wide) f JOIN wide w ON w.day BETWEEN f.day - 14 AND f.day - 1 GROUP BY 1 HAVING count(*) >= 20),
fit AS ({_PAIR.format('day', 1)} FROM mom),
contrib AS (SELECT ts, 'naive_d1' AS feature, 'lag' AS grp, b1 * (x1 - m1) / s1 AS c, my AS level FROM wide JOIN fit USING (day) UNION ALL SELECT ts, 'naive_d7', 'lag', b2 * (x2 - m2) / s2, my FROM wide JOIN fit USING (day))"""


def contributions(spark, d):
    """ts, feature, grp, c, level: each day's fitted coefficient times the standardised feature. A row's contributions and its level add up to its prediction."""
    rows, x = wide_panel(spark, d).where("naive_d1 IS NOT NULL AND naive_d7 IS NOT NULL"), ["naive_d1", "naive_d7"]
    c = R.contributions(rows, R.fit_windows(rows, x, "y", 14, 20), x)
    return c.select("ts", "feature", F.when(F.col("feature").startswith("naive"), "lag").otherwise("other").alias("grp"), F.col("contribution").alias("c"), "level")


@query("I1_contributions", f"WITH {PANEL}, {_CONTRIB} SELECT ts, feature, round(c, 5) AS c FROM contrib")
def i1(spark, d):
    return contributions(spark, d).select("ts", "feature", rounded(F.col("c"), 5).alias("c"))


@query("I2_feature_groups", "SELECT DISTINCT p_name AS feature, CASE WHEN regexp_matches(p_name, '^(a|b|c)') THEN 'first' WHEN regexp_matches(p_name, '[0-9]*[02468]$') THEN 'even' ELSE 'rest' END AS grp FROM part")
def i2(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(n.alias("feature"), F.when(n.rlike("^(a|b|c)"), "first").when(n.rlike("[0-9]*[02468]$"), "even").otherwise("rest").alias("grp")).distinct()


@query("I3_group_importance", f"WITH {PANEL}, {_CONTRIB}, s AS (SELECT ts, feature, sum(c) AS c FROM contrib GROUP BY 1, 2), g AS (SELECT feature, avg(abs(c)) AS mean_abs, median(abs(c)) AS median_abs FROM s GROUP BY 1) SELECT feature, round(mean_abs, 5) AS mean_abs, round(median_abs, 5) AS median_abs, round(mean_abs / sum(mean_abs) OVER (), 6) AS share FROM g")
def i3(spark, d):
    s = contributions(spark, d).groupBy("ts", "feature").agg(F.sum("c").alias("c"))
    g = s.groupBy("feature").agg(F.avg(F.abs("c")).alias("m"), F.median(F.abs("c")).alias("q"))
    return g.select("feature", rounded(F.col("m"), 5).alias("mean_abs"), rounded(F.col("q"), 5).alias("median_abs"), rounded(F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1)))).alias("share"))


@query("I4_subgroup_shares", f"WITH {PANEL}, {_CONTRIB}, g AS (SELECT hour({LOCAL})::INTEGER AS hour, feature, sum(abs(c)) AS w FROM contrib GROUP BY 1, 2) SELECT hour, feature, round(w / sum(w) OVER (PARTITION BY hour), 6) AS share FROM g")
def i4(spark, d):
    g = contributions(spark, d).groupBy(F.hour(T.local(F.col("ts"))).alias("hour"), "feature").agg(F.sum(F.abs("c")).alias("w"))
    return g.select("hour", "feature", rounded(F.col("w") / F.sum("w").over(Window.partitionBy("hour"))).alias("share"))


@query("I5_sampled_days", f"WITH {SERIES}, d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {DAY} AS day FROM series)) SELECT s.ts FROM series s JOIN d ON d.day = (s.ts + INTERVAL 1 HOUR)::DATE WHERE d.i IN (SELECT round(k * (n - 1) / 4.0)::BIGINT FROM d, range(5) t(k)) AND (hour(s.ts + INTERVAL 1 HOUR) * 4 + minute(s.ts + INTERVAL 1 HOUR) // 15) % 8 = 0")
def i5(spark, d):
    s = series(spark, d).withColumn("day", T.local_day(F.col("ts")))
    days = s.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    chosen = days.where(M.evenly_spaced(F.col("n"), F.col("i"), 5)).select("day")
    return s.join(F.broadcast(chosen), "day").where(T.mtu(F.col("ts")) % 8 == 0).select("ts")


@query("I6_beeswarm", f"WITH {PANEL}, {_CONTRIB} SELECT c.ts, c.feature, round(c.c, 5) AS c, round(p.y_pred, 6) AS value FROM contrib c JOIN panel p ON p.ts = c.ts AND p.model = c.feature WHERE c.feature = 'naive_d7'")
def i6(spark, d):
    raw = panel(spark, d).select("ts", F.col("model").alias("feature"), F.col("y_pred").alias("value"))
    return contributions(spark, d).where("feature = 'naive_d7'").join(raw, ["ts", "feature"]).select("ts", "feature", rounded(F.col("c"), 5).alias("c"), rounded(F.col("value")).alias("value"))
