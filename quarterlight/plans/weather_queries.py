"""Weather and physics queries (family E)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics as H
from ..functions import time as T
from ..functions.numeric import clip, rounded, rounded_up, safe_ratio
from ..operators import weather as W
from .frames import AREAS, CLUSTERS, DAY, LOCAL, SERIES, areas, clusters, out, query, series

WEATHER = f"""{CLUSTERS}, weather AS (SELECT ts, cluster_id, cluster_id % 2 AS region, (1 + 10 * cluster_id)::DOUBLE AS cap, v / 5 AS speed, 270 + v / 4 AS t2m, 101325 - 10 * v AS p, v * 8 AS ghi, v * 3 AS direct,
 least(1, v / 100) AS cloud, (v / 5) * cos(cluster_id) AS u, (v / 5) * sin(cluster_id) AS w FROM clusters)"""


def weather(spark, d):
    v, c = F.col("v"), F.col("cluster_id")
    return clusters(spark, d).select(
        "ts", "cluster_id", (c % 2).alias("region"), (1 + 10 * c).cast("double").alias("cap"), (v / 5).alias("speed"), (270 + v / 4).alias("t2m"), (101325 - 10 * v).alias("p"),
        (v * 8).alias("ghi"), (v * 3).alias("direct"), F.least(F.lit(1.0), v / 100).alias("cloud"), (v / 5 * F.cos(c)).alias("u"), (v / 5 * F.sin(c)).alias("w"),
    )


def curve(s: str) -> str:
    return f"(CASE WHEN {s} >= 3 AND {s} < 12 THEN pow(({s} - 3) / 9, 3) WHEN {s} >= 12 AND {s} <= 25 THEN 1 ELSE 0 END)"


_NODES, _WEIGHTS = np.polynomial.hermite_e.hermegauss(7)
_WEIGHTS = _WEIGHTS / _WEIGHTS.sum()
_SMEAR = " + ".join(f"{float(w)!r}::DOUBLE * {curve(f'greatest(0, speed + {float(1.5 * n)!r}::DOUBLE)')}" for n, w in zip(_NODES, _WEIGHTS, strict=True))


@query("E1_power_curve", f"WITH {WEATHER} SELECT ts, cluster_id, round({curve('speed')}, 6) AS sharp, round(greatest(0, least(1, {_SMEAR})), 6) AS smeared FROM weather")
def e1(spark, d):
    s = F.col("speed")
    return weather(spark, d).select("ts", "cluster_id", rounded(H.power_curve(s)).alias("sharp"), rounded(H.smeared_power_curve(s, 1.5)).alias("smeared"))


@query("E2_shear", f"WITH {WEATHER} SELECT ts, cluster_id, round(speed * pow(100 / 10, 1 / 7) + 1e-9, 6) AS hub, round(speed * speed + 1e-9, 6) AS speed2, round(speed * speed * speed + 1e-9, 5) AS speed3 FROM weather")
def e2(spark, d):
    s = F.col("speed")
    return weather(spark, d).select("ts", "cluster_id", rounded_up(H.shear(s, 10.0, 100.0)).alias("hub"), rounded_up(s * s).alias("speed2"), rounded_up(s * s * s, 5).alias("speed3"))


@query("E3_hub_interpolation", f"WITH {WEATHER} SELECT ts, cluster_id, round(greatest(0, speed + greatest(-1, least(2.5, (60 + 20 * cluster_id - 80) / 40)) * (speed * 1.1 - speed)), 6) AS hub FROM weather")
def e3(spark, d):
    s = F.col("speed")
    return weather(spark, d).select("ts", "cluster_id", rounded(H.hub_speed(s, s * 1.1, 60.0 + 20 * F.col("cluster_id"))).alias("hub"))


@query("E4_air_density", f"WITH {WEATHER} SELECT ts, cluster_id, round(p / (287.05 * t2m), 6) AS density, round(p / (287.05 * t2m) * speed * speed * speed, 5) AS cubic FROM weather")
def e4(spark, d):
    rho, s = H.air_density(F.col("p"), F.col("t2m")), F.col("speed")
    return weather(spark, d).select("ts", "cluster_id", rounded(rho).alias("density"), rounded(rho * s * s * s, 5).alias("cubic"))


_MOM = "sum(cap * speed) / sum(cap)"


@query("E5_weighted_moments", f"WITH {WEATHER} SELECT ts, region, round({_MOM}, 6) AS mean, round(sqrt(greatest(sum(cap * speed * speed) / sum(cap) - pow({_MOM}, 2), 0)), 5) AS std FROM weather GROUP BY 1, 2")
def e5(spark, d):
    s, c = F.col("speed"), F.col("cap")
    return weather(spark, d).groupBy("ts", "region").agg(rounded(W.mean0(s, c)).alias("mean"), rounded(W.std0(s, c), 5).alias("std"))


@query("E6_direction", f"WITH {WEATHER} SELECT ts, region, round(sum(cap * u / speed) / sum(cap), 6) AS u, round(sum(cap * w / speed) / sum(cap), 6) AS v FROM weather GROUP BY 1, 2")
def e6(spark, d):
    u, v = W.direction(F.col("u"), F.col("w"), F.col("cap"))
    return weather(spark, d).groupBy("ts", "region").agg(rounded(u).alias("u"), rounded(v).alias("v"))


@query("E7_regional_wind", f"""WITH {WEATHER} SELECT ts, region, round(sum(cap * {curve('speed')}), 5) AS proxy_mw, round(sum(cap * speed * speed * speed) / sum(cap), 4) AS cubic, round({_MOM}, 6) AS speed, round(sum(cap * t2m) / sum(cap), 6) AS t2m, round(sum(cap * p) / sum(cap), 5) AS pressure, round(max(speed), 6) AS gust FROM weather GROUP BY 1, 2""")
def e7(spark, d):
    s, c = F.col("speed"), F.col("cap")
    return weather(spark, d).groupBy("ts", "region").agg(
        rounded(F.sum(c * H.power_curve(s)), 5).alias("proxy_mw"), rounded(W.mean0(s * s * s, c), 4).alias("cubic"), rounded(W.mean0(s, c)).alias("speed"),
        rounded(W.mean0(F.col("t2m"), c)).alias("t2m"), rounded(W.mean0(F.col("p"), c), 5).alias("pressure"), rounded(F.max(s)).alias("gust"),
    )


@query("E8_regional_solar", f"WITH {WEATHER} SELECT ts, region, round(sum(cap * ghi / 1000 * 0.85), 5) AS proxy_mw, round(sum(cap * direct) / sum(cap), 5) AS direct, round(sum(cap * (ghi - direct)) / sum(cap), 5) AS diffuse, round(CASE WHEN sum(cap * ghi) > 1e-6 THEN sum(cap * (ghi - direct)) / sum(cap * ghi) ELSE 0 END, 6) AS diffuse_share FROM weather GROUP BY 1, 2")
def e8(spark, d):
    c, g, b = F.col("cap"), F.col("ghi"), F.col("direct")
    return weather(spark, d).groupBy("ts", "region").agg(
        rounded(F.sum(c * g / 1000 * 0.85), 5).alias("proxy_mw"), rounded(W.mean0(b, c), 5).alias("direct"), rounded(W.mean0(g - b, c), 5).alias("diffuse"),
        rounded(safe_ratio(F.sum(c * (g - b)), F.sum(c * g))).alias("diffuse_share"),
    )


@query("E9_totals", f"WITH {WEATHER}, t AS (SELECT ts, sum(cap * {curve('speed')}) AS wind, sum(cap * ghi / 1000) AS solar FROM weather GROUP BY 1) SELECT ts, round(wind, 5) AS wind, round(solar, 5) AS solar, round(wind + solar, 5) AS total, round(wind + solar - lag(wind + solar, 1) OVER (ORDER BY ts), 5) AS ramp FROM t")
def e9(spark, d):
    t = weather(spark, d).groupBy("ts").agg(F.sum(F.col("cap") * H.power_curve(F.col("speed"))).alias("wind"), F.sum(F.col("cap") * F.col("ghi") / 1000).alias("solar"))
    total = F.col("wind") + F.col("solar")
    ramp = total - F.lag(total, 1).over(Window.orderBy("ts"))  # one row a step of the time grid
    return t.select("ts", *[rounded(x, 5).alias(n) for x, n in ((F.col("wind"), "wind"), (F.col("solar"), "solar"), (total, "total"), (ramp, "ramp"))])


@query("E10_model_levels", f"""WITH {WEATHER}, l AS (SELECT ts, region, level, sum(cap * speed * (1 + level / 10)) / sum(cap) AS m FROM weather, (VALUES (1), (2), (3)) t(level) GROUP BY 1, 2, 3)
SELECT ts, region, level, round(m + 1e-9, 6) AS m, round(m - lag(m) OVER w + 1e-9, 6) AS diff, round(m / lag(m) OVER w + 1e-9, 6) AS ratio FROM l WINDOW w AS (PARTITION BY ts, region ORDER BY level)""")
def e10(spark, d):
    x = weather(spark, d).withColumn("level", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    g = x.groupBy("ts", "region", "level").agg(W.mean0(F.col("speed") * (1 + F.col("level") / 10), F.col("cap")).alias("m"))
    before = F.lag("m").over(Window.partitionBy("ts", "region").orderBy("level"))
    return g.select("ts", "region", "level", rounded_up(F.col("m")).alias("m"), rounded_up(F.col("m") - before).alias("diff"), rounded_up(F.col("m") / before).alias("ratio"))


@query("E11_cluster_proxies", f"WITH {WEATHER} SELECT ts, cluster_id, round(cap * {curve('speed')}, 6) AS wind, round(cap * ghi / 1000, 6) AS solar FROM weather")
def e11(spark, d):
    return weather(spark, d).select("ts", "cluster_id", rounded(F.col("cap") * H.power_curve(F.col("speed"))).alias("wind"), rounded(F.col("cap") * F.col("ghi") / 1000).alias("solar"))


@query("E12_cloud_cover", f"WITH {WEATHER} SELECT ts, region, round(sum(cap * cloud) / sum(cap), 6) AS mean, round(min(cloud), 6) AS min, round(max(cloud), 6) AS max FROM weather GROUP BY 1, 2")
def e12(spark, d):
    c = F.col("cloud")
    return weather(spark, d).groupBy("ts", "region").agg(rounded(W.mean0(c, F.col("cap"))).alias("mean"), rounded(F.min(c)).alias("min"), rounded(F.max(c)).alias("max"))


@query("E15_degree_days", f"WITH {WEATHER} SELECT ts, cluster_id, round(greatest(15 - (t2m - 273.15), 0), 6) AS hdd_15, round(greatest(18 - (t2m - 273.15), 0), 6) AS hdd_18, round(greatest((t2m - 273.15) - 22, 0), 6) AS cdd_22 FROM weather")
def e15(spark, d):
    t = F.col("t2m") - 273.15
    return weather(spark, d).select("ts", "cluster_id", rounded(F.greatest(15 - t, F.lit(0.0))).alias("hdd_15"), rounded(F.greatest(18 - t, F.lit(0.0))).alias("hdd_18"), rounded(F.greatest(t - 22, F.lit(0.0))).alias("cdd_22"))


def vp(t: str) -> str:
    return f"6.1094 * exp(17.625 * {t} / (243.04 + {t}))"


@query("E16_humidity", f"WITH {WEATHER}, t AS (SELECT ts, cluster_id, t2m - 273.15 AS a, t2m - 278.15 AS b FROM weather) SELECT ts, cluster_id, round(greatest(0, least(100, 100 * {vp('b')} / ({vp('a')}))), 6) AS humidity, round(greatest(0, {vp('a')} - {vp('b')}), 6) AS deficit FROM t")
def e16(spark, d):
    a, b = H.vapour_pressure(F.col("t2m") - 273.15), H.vapour_pressure(F.col("t2m") - 278.15)
    return weather(spark, d).select("ts", "cluster_id", rounded(clip(100 * b / a, 0.0, 100.0)).alias("humidity"), rounded(clip(a - b, 0.0)).alias("deficit"))


@query("E18_available_mean", f"WITH {WEATHER}, n AS (SELECT ts, region, cap, CASE WHEN cluster_id <> 3 OR hour(ts) % 2 = 0 THEN t2m END AS x FROM weather) SELECT ts, region, round(sum(cap * x) / sum(cap) FILTER (x IS NOT NULL), 6) AS t2m FROM n GROUP BY 1, 2")
def e18(spark, d):
    n = weather(spark, d).withColumn("x", F.when((F.col("cluster_id") != 3) | (F.hour("ts") % 2 == 0), F.col("t2m")))
    return n.groupBy("ts", "region").agg(rounded(W.available_mean(F.col("x"), F.col("cap"))).alias("t2m"))


@query("E19_spread", f"WITH {WEATHER} SELECT ts, round(avg(t2m) + 1e-9, 6) AS mean, round(min(t2m) + 1e-9, 6) AS min, round(max(t2m) + 1e-9, 6) AS max, round(max(t2m) - min(t2m) + 1e-9, 6) AS range, round(stddev_samp(t2m) + 1e-9, 5) AS std, round(quantile_cont(t2m, 0.1) + 1e-9, 6) AS p10, round(quantile_cont(t2m, 0.9) + 1e-9, 6) AS p90 FROM weather GROUP BY 1")
def e19(spark, d):
    s = W.spread(weather(spark, d), ["ts"], "t2m")
    return s.select("ts", *[rounded_up(F.col(c), 5 if c == "std" else 6).alias(c) for c in ("mean", "min", "max", "range", "std", "p10", "p90")])


@query("E20_weighted_quantiles", f"""WITH {WEATHER}, c AS (SELECT ts, t2m, sum(cap) OVER (PARTITION BY ts ORDER BY t2m, cluster_id ROWS UNBOUNDED PRECEDING) AS cum, sum(cap) OVER (PARTITION BY ts) AS total FROM weather)
SELECT ts, round(min(t2m) FILTER (cum >= 0.1 * total - 1e-12), 6) AS q10, round(min(t2m) FILTER (cum >= 0.5 * total - 1e-12), 6) AS q50, round(min(t2m) FILTER (cum >= 0.9 * total - 1e-12), 6) AS q90 FROM c GROUP BY 1""")
def e20(spark, d):
    return out(W.weighted_quantiles(weather(spark, d), ["ts"], "t2m", "cap", [0.1, 0.5, 0.9], "cluster_id"), ["ts"], "q10", "q50", "q90")


@query("E21_daily_difference", f"WITH {CLUSTERS}, g AS (SELECT cluster_id, {DAY} AS day, avg(v) AS mean, min(v) AS min, max(v) AS max FROM clusters GROUP BY 1, 2) SELECT a.cluster_id, a.day, round(a.mean, 6) AS mean, round(a.min, 6) AS min, round(a.max, 6) AS max, round(a.max - a.min, 6) AS range, round(a.mean - b.mean, 6) AS diff_1d FROM g a LEFT JOIN g b ON b.cluster_id = a.cluster_id AND b.day = a.day - 1")
def e21(spark, d):
    return out(W.daily_difference(clusters(spark, d), ["cluster_id"], "v", 1), ["cluster_id", "day"], "mean", "min", "max", "range", "diff_1d")


@query("E22_inertia", f"""WITH {AREAS}, r AS (SELECT area, ts, v, avg(v) OVER w AS mean, min(v) OVER w AS min, max(v) OVER w AS max, count(v) OVER w AS n FROM areas WINDOW w AS (PARTITION BY area ORDER BY ts RANGE BETWEEN INTERVAL 7199 SECOND PRECEDING AND CURRENT ROW))
SELECT area, ts, CASE WHEN n >= 4 THEN round(mean, 5) END AS mean, CASE WHEN n >= 4 THEN round(max - min, 6) END AS range, CASE WHEN n >= 4 THEN round(v - mean, 5) END AS delta FROM r""")
def e22(spark, d):
    i = W.inertia(areas(spark, d), ["area"], "v", 2)
    return i.select("area", "ts", rounded(F.col("mean"), 5).alias("mean"), rounded(F.col("range")).alias("range"), rounded(F.col("delta"), 5).alias("delta"))


@query("E23_interactions", f"WITH {WEATHER} SELECT ts, cluster_id, round(t2m * sin(2 * pi() * hour({LOCAL}) / 24) + 1e-9, 5) AS x_sin, round(t2m * cos(2 * pi() * hour({LOCAL}) / 24) + 1e-9, 5) AS x_cos, round(CASE WHEN (dayofweek({LOCAL}) + 6) % 7 >= 5 THEN t2m ELSE 0 END, 6) AS x_weekend FROM weather")
def e23(spark, d):
    here, t = T.local(F.col("ts")), F.col("t2m")
    angle = F.lit(2 * math.pi / 24) * F.hour(here)
    return weather(spark, d).select("ts", "cluster_id", rounded_up(t * F.sin(angle), 5).alias("x_sin"), rounded_up(t * F.cos(angle), 5).alias("x_cos"), rounded(F.when(F.weekday(here) >= 5, t).otherwise(0.0)).alias("x_weekend"))


@query("E24_provider_ensemble", f"WITH {WEATHER} SELECT ts, count(speed) AS n, round(avg(speed), 6) AS mean, round(stddev_pop(speed), 5) AS std, round(max(speed) - min(speed), 6) AS range, round(avg(speed) FILTER (cluster_id < 4) - avg(speed) FILTER (cluster_id >= 4), 6) AS group_diff FROM weather GROUP BY 1")
def e24(spark, d):
    s, low = F.col("speed"), F.col("cluster_id") < 4
    return weather(spark, d).groupBy("ts").agg(F.count(s).alias("n"), rounded(F.avg(s)).alias("mean"), rounded(F.stddev_pop(s), 5).alias("std"), rounded(F.max(s) - F.min(s)).alias("range"), rounded(F.avg(F.when(low, s)) - F.avg(F.when(~low, s))).alias("group_diff"))


_RISK = "1 / (1 + exp(-greatest(-40, least(40, (mean - {0}) / greatest(std, 0.5)))))"


@query("E25_cutout_risk", f"""WITH {WEATHER}, m AS (SELECT ts, region, avg(speed) AS mean, stddev_pop(speed) AS std FROM weather GROUP BY 1, 2)
SELECT ts, """ + ", ".join(f"round(avg({_RISK.format(t)}), 5) AS risk_{t}, round(max({_RISK.format(t)}), 5) AS max_risk_{t}, round(avg((mean >= {t})::INT), 6) AS share_{t}, round(max(greatest(mean - {t}, 0)), 6) AS excess_{t}" for t in (8, 12)) + " FROM m GROUP BY 1")
def e25(spark, d):
    m = weather(spark, d).groupBy("ts", "region").agg(F.avg("speed").alias("mean"), F.stddev_pop("speed").alias("std"))
    x = W.exceedance(m, ["ts"], [8.0, 12.0], 0.5)
    return x.select("ts", *[rounded(F.col(c), 5 if "risk" in c else 6).alias(c) for c in x.columns[1:]])


@query("E27_high_regime", f"WITH {WEATHER} SELECT ts, region, round(max(speed), 6) AS max, round(avg(speed), 6) AS mean, round(avg((speed >= 10)::INT), 6) AS share_high, round(max(greatest(speed - 10, 0)), 6) AS excess FROM weather GROUP BY 1, 2")
def e27(spark, d):
    s = F.col("speed")
    return weather(spark, d).groupBy("ts", "region").agg(rounded(F.max(s)).alias("max"), rounded(F.avg(s)).alias("mean"), rounded(F.avg((s >= 10).cast("int"))).alias("share_high"), rounded(F.max(F.greatest(s - 10, F.lit(0.0)))).alias("excess"))


@query("E28_direction_regime", f"WITH {WEATHER}, r AS (SELECT ts, region, sum(cap * u / speed) / sum(cap) AS a, sum(cap * w / speed) / sum(cap) AS b, sum(cap * {curve('speed')}) AS mw FROM weather GROUP BY 1, 2) SELECT ts, region, round(sqrt(a * a + b * b), 6) AS resultant, round(mw * a, 5) AS mw_u, round(mw * b, 5) AS mw_v FROM r")
def e28(spark, d):
    u, v = W.direction(F.col("u"), F.col("w"), F.col("cap"))
    r = weather(spark, d).groupBy("ts", "region").agg(u.alias("a"), v.alias("b"), F.sum(F.col("cap") * H.power_curve(F.col("speed"))).alias("mw"))
    a, b = F.col("a"), F.col("b")
    return r.select("ts", "region", rounded(F.sqrt(a * a + b * b)).alias("resultant"), rounded(F.col("mw") * a, 5).alias("mw_u"), rounded(F.col("mw") * b, 5).alias("mw_v"))


@query("E29_regional_summary", f"WITH {AREAS} SELECT ts, round(sum(v), 4) AS total, round(max(v), 6) AS max, round(min(v), 6) AS min, round(max(v) - min(v), 6) AS spread, round(stddev_samp(v), 5) AS std, round(list_sum(list_reverse_sort(list(v))[1:2]), 6) AS top2 FROM areas GROUP BY 1")
def e29(spark, d):
    s = W.regional_summary(areas(spark, d), ["ts"], "v")
    return s.select("ts", rounded(F.col("total"), 4).alias("total"), *[rounded(F.col(c), 5 if c == "std" else 6).alias(c) for c in ("max", "min", "spread", "std", "top2")])


@query("E30_provider_ratio", f"WITH {AREAS}, w AS (SELECT ts, max(v) FILTER (area = 'click') AS a, max(v) FILTER (area = 'view') AS b FROM areas GROUP BY ts) SELECT ts, round(CASE WHEN a > 10 THEN greatest(0, least(3, b / a)) ELSE 1 END, 6) AS ratio, round(b - a, 6) AS difference FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def e30(spark, d):
    w = areas(spark, d).groupBy("ts").pivot("area", ["click", "view"]).agg(F.max("v")).na.drop()
    a, b = F.col("click"), F.col("view")
    return w.select("ts", rounded(F.when(a > 10, clip(b / a, 0.0, 3.0)).otherwise(1.0)).alias("ratio"), rounded(b - a).alias("difference"))


_SUN = """sun0 AS (SELECT *, hour(ts) * 60.0::DOUBLE + minute(ts) + second(ts) / 60 AS mi FROM sites),
sun1 AS (SELECT *, 2 * pi() / 365 * (dayofyear(ts) - 1 + (mi / 60 - 12) / 24) AS g FROM sun0),
sun2 AS (SELECT *, 229.18 * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(g) - 0.032077::DOUBLE * sin(g) - 0.014615::DOUBLE * cos(2 * g) - 0.040849::DOUBLE * sin(2 * g)) AS eq,
 0.006918::DOUBLE - 0.399912::DOUBLE * cos(g) + 0.070257::DOUBLE * sin(g) - 0.006758::DOUBLE * cos(2 * g) + 0.000907::DOUBLE * sin(2 * g) - 0.002697::DOUBLE * cos(3 * g) + 0.00148::DOUBLE * sin(3 * g) AS de FROM sun1),
sun3 AS (SELECT *, radians(((mi + eq + 4 * lon) % 1440 + 1440) % 1440 / 4 - 180) AS ha, radians(lat) AS la FROM sun2),
sun AS (SELECT *, greatest(-1, least(1, sin(la) * sin(de) + cos(la) * cos(de) * cos(ha))) AS cz FROM sun3)"""
# Five points of the example solar geometry (name, latitude, longitude).
SITES = (("north", 53.5, 10.0), ("east", 51.5, 13.0), ("south", 48.5, 11.5), ("west", 51.0, 7.0), ("centre", 50.5, 9.5))
_SITES = f"{SERIES}, sites AS (SELECT ts, v, name, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM series, (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in SITES) + ") t(name, lat, lon))"


def sites(spark, d):
    dim = spark.createDataFrame(list(SITES), "name string, lat double, lon double")
    return series(spark, d).crossJoin(F.broadcast(dim))  # five rows


@query("E31_solar_position", f"WITH {_SITES}, {_SUN} SELECT ts, name, round(cz, 6) AS cos_zenith, round(degrees(asin(cz)), 5) AS elevation_deg, round(pow(greatest(cz, 0), 1.25), 6) AS clear_sky, (cz > 0)::INT::DOUBLE AS is_daylight FROM sun")
def e31(spark, d):
    p = H.solar_position(F.col("ts"), F.col("lat"), F.col("lon"))
    return sites(spark, d).select("ts", "name", rounded(p["cos_zenith"]).alias("cos_zenith"), rounded(p["elevation_deg"], 5).alias("elevation_deg"), rounded(p["clear_sky"]).alias("clear_sky"), p["is_daylight"].alias("is_daylight"))


@query("E32_solar_geometry", f"WITH {_SITES}, {_SUN}, k AS (SELECT ts, v, pow(greatest(cz, 0), 1.25) AS c FROM sun) SELECT ts, round(avg(c), 6) AS mean, round(max(c), 6) AS max, round(max(c) - min(c), 6) AS spread, round(avg(CASE WHEN 1000 * c > 1 THEN least(2, v / (1000 * c)) ELSE 0 END), 5) AS clear_sky_index FROM k GROUP BY ts")
def e32(spark, d):
    s = sites(spark, d).withColumn("c", H.solar_position(F.col("ts"), F.col("lat"), F.col("lon"))["clear_sky"])
    index = clip(safe_ratio(F.col("v"), 1000 * F.col("c"), 1.0), None, 2.0)
    return s.groupBy("ts").agg(rounded(F.avg("c")).alias("mean"), rounded(F.max("c")).alias("max"), rounded(F.max("c") - F.min("c")).alias("spread"), rounded(F.avg(index), 5).alias("clear_sky_index"))


@query("E33_solar_physics", f"""WITH {WEATHER}, p AS (SELECT ts, cap, ghi, greatest(0, least(1, CASE WHEN ghi > 1e-6 THEN direct / ghi ELSE 0 END)) AS ds, greatest(0.75, least(1.15, 1 - 0.004 * (t2m - 273.15 + 0.025 * ghi - 25))) AS eff FROM weather)
SELECT ts, round(sum(cap * ds), 5) AS direct_mw, round(sum(cap * (1 - ds)), 5) AS diffuse_mw, round(sum(cap * ghi / 1000 * eff), 5) AS corrected_mw FROM p GROUP BY ts""")
def e33(spark, d):
    share = clip(safe_ratio(F.col("direct"), F.col("ghi")), 0.0, 1.0)
    eff, cap = H.module_efficiency(F.col("t2m") - 273.15, F.col("ghi")), F.col("cap")
    return weather(spark, d).groupBy("ts").agg(rounded(F.sum(cap * share), 5).alias("direct_mw"), rounded(F.sum(cap * (1 - share)), 5).alias("diffuse_mw"), rounded(F.sum(cap * F.col("ghi") / 1000 * eff), 5).alias("corrected_mw"))


@query("E34_solar_baseline", f"WITH {WEATHER} SELECT ts, coalesce(region, -1)::INTEGER AS region, round(sum(cap * ghi / 1000 * greatest(0.75, least(1.15, 1 - 0.004 * (t2m - 273.15 + 0.025 * ghi - 25)))), 5) AS baseline FROM weather GROUP BY GROUPING SETS ((ts, region), (ts))")
def e34(spark, d):
    x = F.col("cap") * F.col("ghi") / 1000 * H.module_efficiency(F.col("t2m") - 273.15, F.col("ghi"))
    ts, region = F.col("ts"), F.col("region")
    return weather(spark, d).groupingSets([[ts, region], [ts]], ts, region).agg(rounded(F.sum(x), 5).alias("baseline")).select("ts", F.coalesce("region", F.lit(-1)).alias("region"), "baseline")


_PLANES = [(30.0, 180.0, 0.6), (20.0, 90.0, 0.2), (20.0, 270.0, 0.2)]
_POA = " + ".join(
    f"{w}::DOUBLE * (dni * greatest(0, cz * {math.cos(math.radians(t))!r}::DOUBLE + sz * {math.sin(math.radians(t))!r}::DOUBLE * cos(az - {math.radians(a)!r}::DOUBLE)) + v * 0.4 * {(1 + math.cos(math.radians(t))) / 2!r}::DOUBLE + 0.2 * v * {(1 - math.cos(math.radians(t))) / 2!r}::DOUBLE)"
    for t, a, w in _PLANES
)


@query("E35_plane_irradiance", f"WITH {_SITES}, {_SUN}, q AS (SELECT *, sqrt(greatest(0, 1 - cz * cz)) AS sz, atan2(sin(ha), cos(ha) * sin(la) - tan(de) * cos(la)) + pi() AS az, greatest(0, least(1400, CASE WHEN cz > 1e-4 THEN v * 0.6 / cz ELSE 0 END)) AS dni FROM sun) SELECT ts, name, round(greatest(0, {_POA}), 4) AS poa FROM q")
def e35(spark, d):
    v = F.col("v")
    position = H.solar_position(F.col("ts"), F.col("lat"), F.col("lon"))
    staged = sites(spark, d).select("ts", "name", "v", *[c.alias(k) for k, c in position.items()])  # each angle once
    sun = {k: F.col(k) for k in position}
    return staged.select("ts", "name", rounded(H.plane_irradiance(v, v * 0.6, v * 0.4, sun, _PLANES), 4).alias("poa"))


@query("E36_forecast_lead", f"WITH {SERIES} SELECT ts, round(epoch(ts - (({DAY} - 1)::TIMESTAMP + INTERVAL 5 HOUR)) / 3600, 6) AS lead_hours FROM series")
def e36(spark, d):
    run = T.plus(T.day_start(F.date_sub(T.local_day(F.col("ts")), 1)), hours=6)
    return series(spark, d).select("ts", rounded((T.seconds(F.col("ts")) - T.seconds(run)) / 3600).alias("lead_hours"))
