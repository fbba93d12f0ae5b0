"""Calendar, lag, partial-day and cutoff queries (family F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.numeric import rounded, rounded_up, safe_ratio
from ..operators import calendar as C
from ..operators import evaluation as E
from ..operators import grid as G
from ..operators import lags as L
from .frames import AREA_GRID, AREAS, DAY, LOCAL, MTU, PANEL, SERIES, areas, out, panel, query, series, table

_MIN = f"(hour({LOCAL}) * 60 + minute({LOCAL}))"


def _cyc(name: str, period: str, k: int) -> str:
    x = f"2 * pi() * {k} * {name} / {period}"
    return f"round(sin({x}), 6) AS {name}_sin_{k}, round(cos({x}), 6) AS {name}_cos_{k}"


_PERIODS = (("mtu", "96"), ("minute_of_day", "1440"), ("dow", "7"), ("month", "12"), ("doy", "365.25"), ("week", "53"))


@query("F1_calendar", f"""WITH {SERIES}, c AS (SELECT ts, {MTU} AS mtu, hour({LOCAL})::INTEGER AS hour, ((dayofweek({LOCAL}) + 6) % 7)::INTEGER AS dow, month({LOCAL})::INTEGER AS month, dayofyear({LOCAL})::INTEGER AS doy, weekofyear({LOCAL})::INTEGER AS week, {_MIN}::INTEGER AS minute_of_day FROM series)
SELECT *, (dow >= 5)::INTEGER AS is_weekend, {", ".join(_cyc(n, p, k) for n, p in _PERIODS for k in (1, 2))} FROM c""")
def f1(spark, d):
    c = C.calendar_features(series(spark, d), 2)
    return out(c, ["ts"], *c.columns[1:])


# Holidays of the example calendar (a dimension table in production).
HOLIDAYS = ("2024-01-01", "2024-01-06", "2024-01-18", "2024-01-23")
_HOL = "hol AS (SELECT day::DATE AS day FROM (VALUES " + ", ".join(f"('{x}')" for x in HOLIDAYS) + ") t(day))"
_DAYS = f"days AS (SELECT DISTINCT {DAY} AS day FROM series)"
_FLAGS = """f0 AS (SELECT day, day IN (SELECT day FROM hol) AS h, day + 1 IN (SELECT day FROM hol) AS nx, day - 1 IN (SELECT day FROM hol) AS pv, (dayofweek(day) + 6) % 7 AS dow FROM days),
flags AS (SELECT day, h::INTEGER AS is_holiday, (h OR dow >= 5)::INTEGER AS is_non_workday, (NOT (h OR dow >= 5) AND nx)::INTEGER AS is_pre_holiday, (NOT (h OR dow >= 5) AND pv)::INTEGER AS is_post_holiday,
 (NOT (h OR dow >= 5) AND (nx OR (dow + 1) % 7 >= 5) AND (pv OR (dow + 6) % 7 >= 5) AND (nx OR pv))::INTEGER AS is_bridge_day FROM f0)"""


def holidays(spark):
    return spark.createDataFrame([(x,) for x in HOLIDAYS], "day string").select(F.col("day").cast("date").alias("day"))


def days(spark, d):
    return series(spark, d).select(T.local_day(F.col("ts")).alias("day")).distinct()


@query("F2_holiday_flags", f"WITH {SERIES}, {_DAYS}, {_HOL}, {_FLAGS} SELECT * FROM flags")
def f2(spark, d):
    return C.day_flags(days(spark, d), holidays(spark))


@query("F3_regional_holidays", f"""WITH {SERIES}, {_DAYS}, w AS (SELECT c_nationkey AS region, round(sum(greatest(c_acctbal, 0)), 2) AS weight FROM customer GROUP BY 1),
hol AS (SELECT region, DATE '2024-01-01' + (region % 31)::INTEGER AS day FROM w),
f AS (SELECT days.day, w.weight, EXISTS (SELECT 1 FROM hol WHERE hol.region = w.region AND hol.day = days.day) AS h, (dayofweek(days.day) + 6) % 7 >= 5 AS we FROM days, w)
SELECT day, round(sum(weight * h::INT) / sum(weight), 6) AS is_holiday_share, round(sum(weight * (h OR we)::INT) / sum(weight), 6) AS is_non_workday_share FROM f GROUP BY day""")
def f3(spark, d):
    w = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("region")).agg(F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))), 2).alias("weight"))
    hol = w.select("region", F.expr("date_add(DATE '2024-01-01', region % 31)").alias("day"))
    return out(C.regional_shares(days(spark, d), hol, w), ["day"], "is_holiday_share", "is_non_workday_share")


@query("F4_regime", f"WITH {SERIES}, {_DAYS}, {_HOL} SELECT day, (day >= DATE '2024-01-15')::INTEGER AS post_regime, (day IN (SELECT day FROM hol))::INTEGER AS is_holiday, " + ", ".join(f"((dayofweek(day) + 6) % 7 = {k})::INTEGER AS dow_{k}" for k in range(7)) + " FROM days")
def f4(spark, d):
    return C.regime_features(days(spark, d), "2024-01-15", holidays(spark))


@query("F5_lags", f"WITH {AREAS} SELECT a.area, a.ts, round(b.v, 6) AS v_lag_1d, round(c.v, 6) AS v_lag_7d FROM areas a LEFT JOIN areas b ON b.area = a.area AND b.ts = a.ts - INTERVAL 1 DAY LEFT JOIN areas c ON c.area = a.area AND c.ts = a.ts - INTERVAL 7 DAY")
def f5(spark, d):
    return out(L.lag_by_time(areas(spark, d), ["area"], [1, 7]), ["area", "ts"], "v_lag_1d", "v_lag_7d")


_STATS = "avg(v) AS mean, min(v) AS min, max(v) AS max, arg_min(v, ts) AS first, arg_max(v, ts) AS last, max(v) - min(v) AS range, arg_max(v, ts) - arg_min(v, ts) AS ramp"


@query("F6_window_stats", f"WITH {AREAS}, s AS (SELECT area, {DAY} AS day, {_STATS} FROM areas WHERE {_MIN} BETWEEN 0 AND 705 GROUP BY 1, 2) SELECT area, day, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in ("mean", "min", "max", "first", "last", "range", "ramp")) + " FROM s")
def f6(spark, d):
    return out(L.window_stats(areas(spark, d), ["area"], 0, 705), ["area", "day"], "mean", "min", "max", "first", "last", "range", "ramp")


@query("F7_point_values", f"WITH {AREAS} SELECT area, {DAY} AS day, round(max(v) FILTER ({_MIN} = 360), 6) AS at_0600, round(max(v) FILTER ({_MIN} = 615), 6) AS at_1015 FROM areas WHERE {_MIN} IN (360, 615) GROUP BY 1, 2")
def f7(spark, d):
    return out(L.point_values(areas(spark, d), ["area"], [360, 615]), ["area", "day"], "at_0600", "at_1015")


def _part(s: int) -> str:
    return f"s{s} AS (SELECT area, {DAY} AS day, avg(v) AS m FROM areas WHERE {_MIN} BETWEEN {s} AND 615 GROUP BY 1, 2), p{s} AS (SELECT a.area, a.day + 1 AS day, a.m, a.m - b.m AS x FROM s{s} a LEFT JOIN s{s} b ON b.area = a.area AND b.day = a.day - 7)"


@query("F8_partial_day", f"WITH {AREAS}, {_part(0)}, {_part(360)}, {_part(540)} SELECT area, day, round(p0.m, 6) AS mean_00, round(p0.x, 6) AS diff_00, round(p360.m, 6) AS mean_06, round(p360.x, 6) AS diff_06, round(p540.m, 6) AS mean_09, round(p540.x, 6) AS diff_09 FROM p0 FULL JOIN p360 USING (area, day) FULL JOIN p540 USING (area, day)")
def f8(spark, d):
    p = L.partial_day(areas(spark, d), ["area"], [0, 360, 540], 615, 7)
    return out(p, ["area", "day"], *p.columns[2:])


@query("F9_partial_generation", f"""WITH {AREAS}, s AS (SELECT area, {DAY} AS day, avg(v) AS mean, arg_max(v, ts) AS last, sum(v) AS total FROM areas WHERE {_MIN} BETWEEN 0 AND 600 GROUP BY 1, 2)
SELECT a.area, a.day + 1 AS day, round(a.mean, 6) AS mean, round(a.last, 6) AS last, round(a.mean - b.mean, 6) AS diff_mean, round(a.last - b.last, 6) AS diff_last FROM s a LEFT JOIN s b ON b.area = a.area AND b.day = a.day - 7""")
def f9(spark, d):
    s = L.window_stats(areas(spark, d), ["area"], 0, 600)
    b = s.select("area", F.date_add("day", 7).alias("day"), F.col("mean").alias("bm"), F.col("last").alias("bl"))
    j = s.join(b, ["area", "day"], "left").select("area", F.date_add("day", 1).alias("day"), "mean", "last", (F.col("mean") - F.col("bm")).alias("diff_mean"), (F.col("last") - F.col("bl")).alias("diff_last"))
    return out(j, ["area", "day"], "mean", "last", "diff_mean", "diff_last")


@query("F10_proxy_error", f"""WITH {PANEL}, s AS (SELECT model, {DAY} AS day, y_true AS a, y_pred AS p, ts FROM panel WHERE {_MIN} BETWEEN 0 AND 600)
SELECT model, day + 1 AS day, round(avg(a), 6) AS actual_mean, round(avg(p), 6) AS proxy_mean, round(avg(a - p), 6) AS error, round(CASE WHEN sum(p) > 1 THEN sum(a) / sum(p) ELSE 1 END, 6) AS ratio, round(arg_max(a - p, ts), 6) AS last FROM s GROUP BY 1, 2""")
def f10(spark, d):
    here = T.local(F.col("ts"))
    p = panel(spark, d).where((F.hour(here) * 60 + F.minute(here)).between(0, 600)).withColumn("e", F.col("y_true") - F.col("y_pred"))
    g = p.groupBy("model", F.date_add(T.local_day(F.col("ts")), 1).alias("day")).agg(
        F.avg("y_true").alias("actual_mean"), F.avg("y_pred").alias("proxy_mean"), F.avg("e").alias("error"),
        safe_ratio(F.sum("y_true"), F.sum("y_pred"), 1.0, 1.0).alias("ratio"), F.max_by("e", "ts").alias("last"),
    )
    return out(g, ["model", "day"], "actual_mean", "proxy_mean", "error", "ratio", "last")


@query("F11_cutoff", f"WITH {SERIES}, {_DAYS} SELECT day, day::TIMESTAMP - INTERVAL 75 MINUTE AS end_of_day, day::TIMESTAMP - INTERVAL 25 HOUR - INTERVAL 15 MINUTE AS before_day, day::TIMESTAMP - INTERVAL 14 HOUR - INTERVAL 45 MINUTE AS morning FROM days")
def f11(spark, d):
    day = F.col("day")
    return days(spark, d).select("day", L.cutoff(day).alias("end_of_day"), L.cutoff(day, before_day=True).alias("before_day"), L.cutoff(day, hour=10, minute=15).alias("morning"))


@query("F12_history_errors", f"""WITH {PANEL}, e AS (SELECT ts, hour({LOCAL})::INTEGER AS hour, y_true - y_pred AS e FROM panel WHERE model = 'naive_d1'), days AS (SELECT DISTINCT {DAY} AS day FROM panel),
c AS (SELECT day, day::TIMESTAMP - INTERVAL 15 HOUR AS cut FROM days)
SELECT day, hour, round(CASE WHEN count(e) >= 20 THEN avg(e) END, 6) AS mean, count(e) AS n FROM c JOIN e ON e.ts <= cut AND e.ts > cut - INTERVAL 7 DAY GROUP BY 1, 2""")
def f12(spark, d):
    p = panel(spark, d)
    e = p.where("model = 'naive_d1'").select("ts", F.hour(T.local(F.col("ts"))).alias("hour"), (-E.errors()).alias("e"))
    return out(L.history_means(e, p.select(T.local_day(F.col("ts")).alias("day")).distinct(), 7, "hour", 20), ["day", "hour"], "mean", "n")


@query("F13_shifts", f"WITH {AREA_GRID} SELECT area, ts, round(lag(v, 2) OVER w, 6) AS v_lag_2, round(lead(v, 1) OVER w, 6) AS v_lead_1, round(v - lag(v, 4) OVER w, 6) AS v_diff_4 FROM grid WINDOW w AS (PARTITION BY area ORDER BY ts)")
def f13(spark, d):
    return out(L.shifts(G.on_grid(areas(spark, d), ["area"]), ["area"], lags=(2,), leads=(1,), diffs=(4,)), ["area", "ts"], "v_lag_2", "v_lead_1", "v_diff_4")


@query("F14_centred_window", f"WITH {AREA_GRID} SELECT area, ts, round(avg(v) OVER w + 1e-9, 6) AS mean, round(stddev_samp(v) OVER w + 1e-9, 5) AS std, round(min(v) OVER w + 1e-9, 6) AS min, round(max(v) OVER w + 1e-9, 6) AS max FROM grid WINDOW w AS (PARTITION BY area ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
def f14(spark, d):
    c = L.centred_window(G.on_grid(areas(spark, d), ["area"]), ["area"], 4)
    return c.select("area", "ts", *[rounded_up(F.col(x), 5 if x == "std" else 6).alias(x) for x in ("mean", "std", "min", "max")])


@query("F15_regional_load", f"""WITH {AREA_GRID}, r AS (SELECT area, ts, v, v - lag(v, 4) OVER w AS ramp, v - lag(v, 96) OVER w AS delta FROM grid WINDOW w AS (PARTITION BY area ORDER BY ts))
SELECT ts, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, round(stddev_samp(v), 5) AS std, round(max(v) - min(v), 6) AS range, round(max(v) / sum(v), 6) AS max_share, round(sum(ramp), 4) AS ramp, round(sum(delta), 4) AS delta FROM r GROUP BY ts""")
def f15(spark, d):
    w = Window.partitionBy("area").orderBy("ts")
    r = G.on_grid(areas(spark, d), ["area"]).withColumn("ramp", F.col("v") - F.lag("v", 4).over(w)).withColumn("delta", F.col("v") - F.lag("v", 96).over(w))
    return r.groupBy("ts").agg(
        rounded(F.sum("v"), 4).alias("total"), rounded(F.avg("v")).alias("mean"), rounded(F.stddev_samp("v"), 5).alias("std"), rounded(F.max("v") - F.min("v")).alias("range"),
        rounded(F.max("v") / F.sum("v")).alias("max_share"), rounded(F.sum("ramp"), 4).alias("ramp"), rounded(F.sum("delta"), 4).alias("delta"),
    )


@query("F16_residual_load", f"""WITH {AREAS}, w AS (SELECT ts, sum(v) - sum(v) FILTER (area IN ('click', 'view')) AS v FROM areas GROUP BY ts)
SELECT ts, round(v, 4) AS v, round(v - lag(v, 4) OVER (ORDER BY ts), 4) AS v_ramp_4, round(v - lag(v, 12) OVER (ORDER BY ts), 4) AS v_ramp_12 FROM w""")
def f16(spark, d):
    w = areas(spark, d).groupBy("ts").agg((F.sum("v") - F.sum(F.when(F.col("area").isin("click", "view"), F.col("v")))).alias("v"))
    r = G.ramps(w, [])
    return r.select("ts", *[rounded(F.col(c), 4).alias(c) for c in ("v", "v_ramp_4", "v_ramp_12")])


@query("F17_price_spreads", f"WITH {AREAS} SELECT a.area AS market, a.ts, round(a.v - r.v, 6) AS spread FROM areas a JOIN areas r ON r.ts = a.ts AND r.area = 'view' WHERE a.area <> 'view'")
def f17(spark, d):
    a = areas(spark, d)
    ref = a.where("area = 'view'").select("ts", F.col("v").alias("r"))
    return a.where("area <> 'view'").join(ref, "ts").select(F.col("area").alias("market"), "ts", rounded(F.col("v") - F.col("r")).alias("spread"))


@query("F20_availability", f"""WITH {AREAS}, w AS (SELECT ts, max(v) FILTER (area = 'click') AS a, max(v) FILTER (area = 'view') AS b, max(v) FILTER (area = 'error') AS c FROM areas GROUP BY ts)
SELECT ts, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS has_all, a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL AS has_any FROM w""")
def f20(spark, d):
    w = areas(spark, d).groupBy("ts").pivot("area", ["click", "view", "error"]).agg(F.max("v"))
    missing = F.size(F.filter(F.array("click", "view", "error"), lambda x: x.isNull()))
    return w.select("ts", (missing == 0).alias("has_all"), (missing < 3).alias("has_any"))
