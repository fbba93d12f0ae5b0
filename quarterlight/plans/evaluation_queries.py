"""Evaluation queries (family J) and naive benchmarks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.numeric import rounded, rounded_up
from ..operators import evaluation as E
from ..operators import grid as G
from .frames import DAY, LOCAL, MTU, PANEL, out, panel, query, series

_METRICS = "round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias"


@query("G21_naive_benchmarks", f"WITH {PANEL} SELECT ts, model, round(y_pred, 6) AS y_pred, round(y_true, 6) AS y_true FROM panel")
def g21(spark, d):
    return out(panel(spark, d), ["ts", "model"], "y_pred", "y_true")


@query("J1_point_metrics", f"WITH {PANEL}, x AS (SELECT model, y_pred - y_true AS e FROM panel) SELECT model, {_METRICS}, count(e) AS n_obs, (count(*) - count(e))::BIGINT AS n_missing FROM x GROUP BY model")
def j1(spark, d):
    return out(E.point_metrics(panel(spark, d), ["model"]), ["model"], "mae", "rmse", "bias", "n_obs", "n_missing")


@query("J2_period_metrics", f"""WITH {PANEL}, x AS (SELECT model, y_true AS y, y_pred - y_true AS e FROM panel)
SELECT model, round(avg(e * e), 4) AS mse, round(1 - sum(e * e) / (sum(y * y) - count(*) * avg(y) * avg(y)), 6) AS r2, round(avg(y), 6) AS mean_true, round(sqrt(avg(e * e)) / avg(y), 6) AS nrmse FROM x GROUP BY model""")
def j2(spark, d):
    m = E.point_metrics(panel(spark, d), ["model"]).withColumn("nrmse", F.col("rmse") / F.col("mean_true"))
    return out(m, ["model"], "r2", "mean_true", "nrmse", "mse").withColumn("mse", rounded(F.col("mse"), 4))


@query("J3_monthly_metrics", f"""WITH {PANEL}, x AS (SELECT model, strftime({LOCAL}, '%Y-%m') AS month, y_pred - y_true AS e FROM panel)
SELECT model, coalesce(month, 'full') AS month, {_METRICS}, count(e) AS n_obs FROM x GROUP BY GROUPING SETS ((model), (model, month))""")
def j3(spark, d):
    return out(E.monthly_metrics(panel(spark, d)), ["model", "month"], "mae", "rmse", "bias", "n_obs")


_QUANTILES = """qs AS (SELECT model, quantile_cont(y_pred - y_true, 0.1) AS r1, quantile_cont(y_pred - y_true, 0.5) AS r5, quantile_cont(y_pred - y_true, 0.9) AS r9 FROM panel GROUP BY model),
qp AS (SELECT p.ts, p.model, p.y_true, t.tau, p.y_pred - CASE t.tau WHEN 0.1 THEN r9 WHEN 0.5 THEN r5 ELSE r1 END AS q FROM panel p JOIN qs USING (model) CROSS JOIN (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(tau))"""


def quantile_panel(spark, d):
    """ts, model, y_true, tau, q: the point forecast minus residual quantiles."""
    p = panel(spark, d).withColumn("e", E.errors())
    r = p.groupBy("model").agg(F.percentile("e", F.array(F.lit(0.9), F.lit(0.5), F.lit(0.1))).alias("r"))
    taus = F.arrays_zip(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)).alias("tau"), F.col("r").alias("r"))
    long = r.select("model", F.explode(taus).alias("x")).select("model", F.col("x.tau").alias("tau"), F.col("x.r").alias("r"))
    return p.join(F.broadcast(long), "model").select("ts", "model", "y_true", "tau", (F.col("y_pred") - F.col("r")).alias("q"))


@query("J4_pinball", f"WITH {PANEL}, {_QUANTILES} SELECT model, round(avg(greatest(tau * (y_true - q), (tau - 1) * (y_true - q))), 6) AS pinball, round(avg(abs(y_true - q)) FILTER (tau = 0.5), 6) AS median_mae FROM qp GROUP BY model")
def j4(spark, d):
    q = quantile_panel(spark, d)
    loss = E.pinball(F.col("q"), F.col("y_true"), F.col("tau"))
    return q.groupBy("model").agg(rounded(F.avg(loss)).alias("pinball"), rounded(F.avg(F.when(F.col("tau") == 0.5, F.abs(F.col("y_true") - F.col("q"))))).alias("median_mae"))


_BANDS = """bands AS (SELECT ts, model, y_true, max(q) FILTER (tau = 0.1) AS lo, max(q) FILTER (tau = 0.9) AS hi FROM qp GROUP BY 1, 2, 3)"""


def bands(spark, d):
    q = quantile_panel(spark, d)
    at = lambda t: F.max(F.when(F.col("tau") == t, F.col("q")))
    return q.groupBy("ts", "model", "y_true").agg(at(0.1).alias("lo"), at(0.9).alias("hi"))


@query("J5_coverage", f"WITH {PANEL}, {_QUANTILES}, {_BANDS} SELECT model, round(avg((y_true BETWEEN lo AND hi)::INT), 6) AS coverage, round(avg(hi - lo), 6) AS width FROM bands GROUP BY model")
def j5(spark, d):
    inside = F.col("y_true").between(F.col("lo"), F.col("hi")).cast("int")
    return bands(spark, d).groupBy("model").agg(rounded(F.avg(inside)).alias("coverage"), rounded(F.avg(F.col("hi") - F.col("lo"))).alias("width"))


@query("J6_kupiec", f"""WITH {PANEL}, {_QUANTILES}, {_BANDS},
k AS (SELECT model, {MTU} AS mtu, count(*) AS n, sum((y_true BETWEEN lo AND hi)::INT)::BIGINT AS k FROM bands GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN k > 0 AND k < n THEN -2 * (k * ln(0.8) + (n - k) * ln(0.2) - k * ln(k / n) - (n - k) * ln(1 - k / n)) END AS lr FROM k)
SELECT model, mtu, n, k, round(lr, 6) AS lr, coalesce(lr <= 3.841458820694124, FALSE) AS accepted FROM l""")
def j6(spark, d):
    own = bands(spark, d).withColumn("mtu", T.mtu(F.col("ts"))).withColumn("hit", F.col("y_true").between(F.col("lo"), F.col("hi")))
    return out(E.kupiec(own, ["model", "mtu"], "hit", 0.2), ["model", "mtu"], "n", "k", "lr", "accepted")


_DAILY = f"daily AS (SELECT model, {DAY} AS day, avg(abs(y_pred - y_true)) AS loss FROM panel GROUP BY 1, 2), diff AS (SELECT a.model AS m1, b.model AS m2, a.day, a.loss - b.loss AS d FROM daily a JOIN daily b ON a.day = b.day AND a.model <> b.model)"
_GW = """lagged AS (SELECT m1, m2, d, lag(d) OVER (PARTITION BY m1, m2 ORDER BY day) AS p FROM diff),
s AS (SELECT m1, m2, sum(d) AS s1, sum(p * d) AS s2, sum(d * d) AS a, sum(d * d * p) AS b, sum(d * d * p * p) AS c, avg(d) AS md, count(*) AS n FROM lagged WHERE p IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN a * c - b * b > 1e-12 * a * c THEN sign(md) * (c * s1 * s1 - 2 * b * s1 * s2 + a * s2 * s2) / (a * c - b * b) END AS stat FROM s)"""


def loss_differences(spark, d):
    p = panel(spark, d).withColumn("day", T.local_day(F.col("ts")))
    daily = p.groupBy("model", "day").agg(F.avg(F.abs(E.errors())).alias("loss"))
    other = daily.select(F.col("model").alias("m2"), "day", F.col("loss").alias("loss2"))
    both = daily.withColumnRenamed("model", "m1").join(other, "day").where("m1 <> m2")
    return both.select("m1", "m2", "day", (F.col("loss") - F.col("loss2")).alias("d"))


@query("J7_predictive_ability", f"WITH {PANEL}, {_DAILY}, {_GW} SELECT m1, m2, n, round(stat, 5) AS statistic, round(CASE WHEN stat > 0 THEN exp(-stat / 2) ELSE 1 END, 6) AS p_value FROM t WHERE m1 = 'naive_d1'")
def j7(spark, d):
    g = E.giacomini_white(loss_differences(spark, d).where("m1 = 'naive_d1'"), ["m1", "m2"])
    return g.select("m1", "m2", "n", rounded(F.col("statistic"), 5).alias("statistic"), rounded(F.col("p_value")).alias("p_value"))


@query("J8_pairwise", f"WITH {PANEL}, {_DAILY}, {_GW} SELECT m1, m2, n, round(stat, 5) AS statistic, round(CASE WHEN stat > 0 THEN exp(-stat / 2) ELSE 1 END, 6) AS p_value FROM t")
def j8(spark, d):
    g = E.giacomini_white(loss_differences(spark, d), ["m1", "m2"])
    return g.select("m1", "m2", "n", rounded(F.col("statistic"), 5).alias("statistic"), rounded(F.col("p_value")).alias("p_value"))


@query("J9_panel_gaps", f"""WITH {PANEL}, days AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-29', INTERVAL 1 DAY)) AS day),
grid AS (SELECT unnest(generate_series(day - INTERVAL 1 HOUR, day + INTERVAL 22 HOUR + INTERVAL 45 MINUTE, INTERVAL 15 MINUTE)) AS ts FROM days), m AS (SELECT DISTINCT model FROM panel)
SELECT model, (SELECT count(*) FROM grid g WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.ts = g.ts AND p.model = m.model))::BIGINT AS missing,
 (SELECT count(*) FROM panel p WHERE p.model = m.model AND p.ts NOT IN (SELECT ts FROM grid))::BIGINT AS extra FROM m""")
def j9(spark, d):
    days = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 23:00:00' AS ts UNION ALL SELECT TIMESTAMP_NTZ '2024-01-29 22:45:00'")
    return E.panel_gaps(panel(spark, d), G.dense_grid(days, []), ["model"])


@query("J10_quantile_order", f"""WITH {PANEL}, {_QUANTILES}, v AS (SELECT model, ts, q < lag(q) OVER (PARTITION BY model, ts ORDER BY tau) AS bad, q FROM qp)
SELECT model, count(*) AS n, count(*) FILTER (q IS NULL) AS n_null, count(*) FILTER (bad) AS n_crossing FROM v GROUP BY model""")
def j10(spark, d):
    q = quantile_panel(spark, d)
    q = q.withColumn("bad", F.col("q") < F.lag("q").over(Window.partitionBy("model", "ts").orderBy("tau")))
    return q.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q").isNull()).alias("n_null"), F.count_if(F.coalesce("bad", F.lit(False))).alias("n_crossing"))


@query("J11_holm", f"""WITH {PANEL}, {_DAILY}, {_GW}, p AS (SELECT m1, m2, CASE WHEN stat > 0 THEN exp(-stat / 2) ELSE 1 END AS p FROM t),
h AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, m1) + 1) * p) AS s FROM p)
SELECT m1, m2, round(max(s) OVER (ORDER BY p, m1 ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""")
def j11(spark, d):
    g = E.giacomini_white(loss_differences(spark, d), ["m1", "m2"])
    return out(E.holm(g, []), ["m1", "m2"], "p_holm")


@query("J12_matched_panel", f"""WITH {PANEL}, m AS (SELECT ts FROM panel WHERE {DAY} <> DATE '2024-01-15' GROUP BY ts HAVING count(DISTINCT model) = 2),
r AS (SELECT model, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, count(*) AS n FROM panel WHERE ts IN (SELECT ts FROM m) GROUP BY model)
SELECT model, n, round(rmse, 6) AS rmse, round(100 * (rmse / (SELECT rmse FROM r WHERE model = 'naive_d1') - 1), 6) AS change FROM r""")
def j12(spark, d):
    p = panel(spark, d)
    p = p.where(T.local_day(F.col("ts")) != F.lit("2024-01-15").cast("date"))
    matched = p.groupBy("ts").agg(F.count_distinct("model").alias("k")).where("k = 2").select("ts")
    m = E.point_metrics(p.join(matched, "ts", "left_semi"), ["model"]).select("model", F.col("n_obs").alias("n"), "rmse")
    base = m.where("model = 'naive_d1'").select(F.col("rmse").alias("base"))
    return out(m.crossJoin(F.broadcast(base)).withColumn("change", 100 * (F.col("rmse") / F.col("base") - 1)), ["model"], "n", "rmse", "change")


@query("J13_quantile_periods", f"""WITH {PANEL}, {_QUANTILES}, x AS (SELECT model, strftime({LOCAL}, '%Y-%m') AS month, tau, y_true - q AS d FROM qp)
SELECT model, coalesce(month, 'full') AS month, round(avg(greatest(tau * d, (tau - 1) * d)), 6) AS pinball, round(avg(abs(d)) FILTER (tau = 0.5), 6) AS median_mae FROM x GROUP BY GROUPING SETS ((model), (model, month))""")
def j13(spark, d):
    q = quantile_panel(spark, d).withColumn("month", F.date_format(T.local(F.col("ts")), "yyyy-MM"))
    sets = q.groupingSets([[F.col("model")], [F.col("model"), F.col("month")]], F.col("model"), F.col("month"))
    m = sets.agg(F.avg(E.pinball(F.col("q"), F.col("y_true"), F.col("tau"))).alias("pinball"), F.avg(F.when(F.col("tau") == 0.5, F.abs(F.col("y_true") - F.col("q")))).alias("median_mae"))
    return out(m.withColumn("month", F.coalesce("month", F.lit("full"))), ["model", "month"], "pinball", "median_mae")


@query("J14_residual_diagnostics", f"""WITH {PANEL}, x AS (SELECT model, y_pred - y_true AS e, hour({LOCAL})::INTEGER AS hour, ((dayofweek({LOCAL}) + 6) % 7)::INTEGER AS weekday, month({LOCAL})::INTEGER AS month FROM panel)
SELECT model, CASE WHEN grouping(hour) = 0 THEN 'hour' WHEN grouping(weekday) = 0 THEN 'weekday' ELSE 'month' END AS dimension, coalesce(hour, weekday, month) AS level, round(avg(abs(e)) + 1e-9, 6) AS mae, round(sqrt(avg(e * e)) + 1e-9, 6) AS rmse, round(avg(e) + 1e-9, 6) AS bias, count(e) AS n_obs
FROM x GROUP BY GROUPING SETS ((model, hour), (model, weekday), (model, month))""")
def j14(spark, d):
    here = T.local(F.col("ts"))
    p = panel(spark, d).select("model", E.errors().alias("e"), F.hour(here).alias("hour"), F.weekday(here).alias("weekday"), F.month(here).alias("month"))
    dims = ["hour", "weekday", "month"]
    sets = p.groupingSets([[F.col("model"), F.col(x)] for x in dims], F.col("model"), *[F.col(x) for x in dims])
    kind = F.when(F.grouping("hour") == 0, "hour").when(F.grouping("weekday") == 0, "weekday").otherwise("month")
    m = sets.agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), F.count("e").alias("n_obs"), kind.alias("dimension"))
    return m.select("model", "dimension", F.coalesce(*dims).alias("level"), *[rounded_up(F.col(c)).alias(c) for c in ("mae", "rmse", "bias")], "n_obs")


@query("J15_regression_gate", f"""WITH {PANEL}, w AS (SELECT ts, max(y_pred) FILTER (model = 'naive_d1') AS a, max(y_pred) FILTER (model = 'naive_d7') AS b, max(y_true) AS y FROM panel GROUP BY ts)
SELECT round(sqrt(avg((a - y) ** 2)), 6) AS rmse, round(max(abs(a - b)), 6) AS max_diff, sqrt(avg((a - y) ** 2)) < 150 AND max(abs(a - b)) < 1e6 AS passed FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def j15(spark, d):
    w = panel(spark, d).groupBy("ts").pivot("model", ["naive_d1", "naive_d7"]).agg(F.max("y_pred")).join(series(spark, d).withColumnRenamed("v", "y"), "ts").na.drop()
    a, b, y = (F.col(c) for c in ("naive_d1", "naive_d7", "y"))
    rmse, most = F.sqrt(F.avg((a - y) * (a - y))), F.max(F.abs(a - b))
    return w.agg(rounded(rmse).alias("rmse"), rounded(most).alias("max_diff"), ((rmse < 150) & (most < 1e6)).alias("passed"))
