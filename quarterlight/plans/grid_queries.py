"""Queries on the time grid (families A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.numeric import rounded, strict_sum
from ..operators import grid as G
from .frames import AREA_GRID, AREAS, DAY, INTERVALS, MTU, SERIES, areas, intervals, out, query, series, table


@query("A1_keep_last", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 15 MINUTE, ts) ORDER BY event_id DESC) AS k FROM events) SELECT event_type AS area, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(value, 6) AS v FROM r WHERE k = 1")
def a1(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("area"), T.bucket(F.col("ts")).alias("ts"), F.col("value").alias("v"), "event_id")
    return out(G.keep_last(e, ["area", "ts"], "event_id"), ["area", "ts"], "v")


@query("A11_incomplete_days", f"""WITH {AREAS},
c AS (SELECT area, {DAY} AS day, count(v) AS n FROM areas GROUP BY 1, 2),
s AS (SELECT area, day, day - (row_number() OVER (PARTITION BY area ORDER BY day))::INTEGER AS g FROM c WHERE n < 96)
SELECT area, min(day) AS "start", max(day) AS "end", count(*)::BIGINT AS days FROM s GROUP BY area, g""")
def a11(spark, d):
    return G.incomplete_days(areas(spark, d), ["area"])


@query("A13_resume_days", f"""WITH {SERIES}, h AS (SELECT DISTINCT {DAY} AS day FROM series WHERE ts < TIMESTAMP '2024-01-16 12:00:00'),
e AS (SELECT unnest(generate_series((SELECT min(day) FROM h)::TIMESTAMP, TIMESTAMP '2024-01-31', INTERVAL 1 DAY))::DATE AS day)
SELECT day FROM e WHERE day NOT IN (SELECT day FROM h)""")
def a13(spark, d):
    cached = series(spark, d).where("ts < TIMESTAMP_NTZ '2024-01-16 12:00:00'").select(T.local_day(F.col("ts")).alias("day")).distinct()
    wanted = cached.agg(F.min("day").alias("a")).select(F.explode(F.sequence("a", F.lit("2024-01-31").cast("date"))).alias("day"))
    return wanted.join(cached, "day", "left_anti")


@query("A15_fallback", f"""WITH {AREAS}, p AS (SELECT ts, v FROM areas WHERE area = 'click'), f AS (SELECT ts, v FROM areas WHERE area = 'view' AND {DAY} <= DATE '2024-01-20')
SELECT ts, round(coalesce(p.v, f.v), 6) AS v FROM p FULL JOIN f USING (ts)""")
def a15(spark, d):
    a = areas(spark, d)
    primary, spare = (a.where(F.col("area") == k).select("ts", "v") for k in ("click", "view"))
    spare = spare.where(T.local_day(F.col("ts")) <= F.lit("2024-01-20").cast("date"))
    return out(G.align(primary, spare, ["ts"], ["v"]), ["ts"], "v")


@query("A20_issue_days", "WITH w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-02-05', INTERVAL 1 DAY))::DATE AS forecast_day), i AS (SELECT forecast_day, forecast_day - 1 AS issue_day FROM w) SELECT forecast_day, issue_day FROM i WHERE issue_day NOT IN (SELECT ts::DATE FROM events)")
def a20(spark, d):
    done = table(spark, d, "events").select(F.col("ts").cast("date").alias("issue_day")).distinct()
    wanted = spark.sql("SELECT explode(sequence(DATE '2024-01-03', DATE '2024-02-05')) AS forecast_day").withColumn("issue_day", F.date_sub("forecast_day", 1))
    return wanted.join(done, "issue_day", "left_anti").select("forecast_day", "issue_day")


@query("A21_landed_frames", f"WITH {AREAS} SELECT ts, round(max(v) FILTER (area = 'click'), 6) AS click, round(max(v) FILTER (area = 'error'), 6) AS error, round(max(v) FILTER (area = 'purchase'), 6) AS purchase, round(max(v) FILTER (area = 'view'), 6) AS \"view\" FROM areas WHERE {DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ts")
def a21(spark, d):
    own = G.restrict_days(areas(spark, d), "2024-01-05", "2024-01-25")
    wide = own.groupBy("ts").pivot("area", ["click", "error", "purchase", "view"]).agg(F.max("v"))
    return out(wide, ["ts"], "click", "error", "purchase", "view")


@query("B1_expand_quarter_hour", f"""WITH {AREA_GRID},
f AS (SELECT area, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY area ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM grid)
SELECT area, ts, CASE WHEN count(v) OVER (PARTITION BY area, {DAY}) = count(*) OVER (PARTITION BY area, {DAY}) THEN round(v, 6) END AS v FROM f""")
def b1(spark, d):
    return out(G.expand_hourly(areas(spark, d), ["area"]), ["area", "ts"], "v")


@query("B2_restrict_window", f"WITH {AREAS} SELECT area, ts, round(v, 6) AS v FROM areas WHERE {DAY} BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND {DAY} <> DATE '2024-01-10'")
def b2(spark, d):
    return out(G.restrict_days(areas(spark, d), "2024-01-08", "2024-01-14", ["2024-01-10"]), ["area", "ts"], "v")


@query("B3_local_days", f"WITH {SERIES}, d AS (SELECT DISTINCT {DAY} AS day FROM series) SELECT day, day::TIMESTAMP - INTERVAL 1 HOUR AS day_start, day::TIMESTAMP + INTERVAL 23 HOUR AS next_day_start FROM d")
def b3(spark, d):
    days = series(spark, d).select(T.local_day(F.col("ts")).alias("day")).distinct()
    return days.select("day", T.day_start(F.col("day")).alias("day_start"), T.next_day_start(F.col("day")).alias("next_day_start"))


@query("B4_slots_of_day", "SELECT DISTINCT o_orderdate::DATE AS day, CASE WHEN month(o_orderdate) = 3 AND dayofweek(o_orderdate) = 0 AND day(o_orderdate) > 24 THEN 92 WHEN month(o_orderdate) = CASE WHEN year(o_orderdate) < 1996 THEN 9 ELSE 10 END AND dayofweek(o_orderdate) = 0 AND day(o_orderdate) > CASE WHEN year(o_orderdate) < 1996 THEN 23 ELSE 24 END THEN 100 ELSE 96 END::INTEGER AS slots FROM orders")
def b4(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", T.slots(F.col("day")).alias("slots"))


@query("B5_mixed_resolution", f"""WITH {AREA_GRID}
SELECT area, ts, round(CASE WHEN area IN ('click', 'view') THEN last_value(v IGNORE NULLS) OVER (PARTITION BY area ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) ELSE v END, 6) AS v FROM grid""")
def b5(spark, d):
    g = G.on_grid(areas(spark, d), ["area"])
    return out(g.withColumn("v", F.when(F.col("area").isin("click", "view"), G.forward_fill(g, ["area"])).otherwise(F.col("v"))), ["area", "ts"], "v")


@query("B6_duplicate_policies", """WITH e AS (SELECT event_type AS area, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, value, event_id FROM events)
SELECT area, ts, round(arg_min(value, event_id), 6) AS first_v, round(arg_max(value, event_id), 6) AS last_v, round(avg(value), 6) AS mean_v FROM e GROUP BY 1, 2""")
def b6(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("area"), T.bucket(F.col("ts")).alias("ts"))
    return out(e.agg(F.min_by("value", "event_id").alias("first_v"), F.max_by("value", "event_id").alias("last_v"), F.avg("value").alias("mean_v")), ["area", "ts"], "first_v", "last_v", "mean_v")


@query("B7_interpolate", f"""WITH {AREA_GRID},
g AS (SELECT area, {DAY} AS day, {MTU} AS mtu, v, CASE WHEN v IS NOT NULL THEN {MTU} END AS k FROM grid),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(k IGNORE NULLS) OVER b AS k0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(k IGNORE NULLS) OVER a AS k1 FROM g
 WINDOW b AS (PARTITION BY area, day ORDER BY mtu ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY area, day ORDER BY mtu ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT area, day, mtu, round(CASE WHEN v IS NOT NULL THEN v WHEN mtu - k0 <= 4 THEN v0 + (v1 - v0) * (mtu - k0) / (k1 - k0) END, 6) AS v FROM w""")
def b7(spark, d):
    g = G.on_grid(areas(spark, d), ["area"]).select("area", T.local_day(F.col("ts")).alias("day"), T.mtu(F.col("ts")).alias("mtu"), "v")
    return out(G.interpolate_in_day(g, ["area", "day"], "mtu", "v", 4), ["area", "day", "mtu"], "v")


_SLOTS = ", ".join(f"round(avg(v) FILTER (m = {i}), 6) AS v_mtu_{i:02d}" for i in range(96))
_HOURS = ", ".join(f"round(avg(v) FILTER (m // 4 = {i}), 6) AS v_mtu_{i:02d}" for i in range(24))


@query("B8_day_matrix", f"WITH {SERIES}, l AS (SELECT {DAY} AS local_day, {MTU} AS m, v FROM series) SELECT local_day, {_SLOTS} FROM l GROUP BY 1")
def b8(spark, d):
    m = G.day_matrix(series(spark, d), [])
    return out(m, ["local_day"], *m.columns[1:])


@query("B9_day_lags", f"""WITH {SERIES}, l AS (SELECT {DAY} AS local_day, sum(v) AS v FROM series GROUP BY 1)
SELECT local_day, round(lag(v, 1) OVER w, 6) AS lag_1, round(lag(v, 2) OVER w, 6) AS lag_2, round(lag(v, 7) OVER w, 6) AS lag_7 FROM l WINDOW w AS (ORDER BY local_day)""")
def b9(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy("local_day")  # one row a day
    days = series(spark, d).groupBy(T.local_day(F.col("ts")).alias("local_day")).agg(F.sum("v").alias("v"))
    return out(days.select("local_day", *[F.lag("v", k).over(w).alias(f"lag_{k}") for k in (1, 2, 7)]), ["local_day"], "lag_1", "lag_2", "lag_7")


@query("B10_day_last", f"WITH {AREAS} SELECT area, {DAY} AS local_day, round(arg_max(v, ts), 6) AS v FROM areas GROUP BY 1, 2")
def b10(spark, d):
    return out(G.day_last(areas(spark, d), ["area"]), ["area", "local_day"], "v")


_PART = "FILTER (m BETWEEN {} AND {})"


@query("B11_day_summary", f"""WITH {AREAS},
l AS (SELECT area, {DAY} AS local_day, {MTU} AS m, v, abs(v - lag(v, 4) OVER (PARTITION BY area, {DAY} ORDER BY ts)) AS r FROM areas)
SELECT area, local_day, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range, round(stddev_samp(v), 6) AS std, round(max(r), 6) AS max_ramp,
 round(avg(v) FILTER (m BETWEEN 28 AND 43), 6) AS morning_mean, round(max(v) FILTER (m BETWEEN 28 AND 43), 6) AS morning_max,
 round(avg(v) FILTER (m BETWEEN 60 AND 75), 6) AS evening_mean, round(max(v) FILTER (m BETWEEN 60 AND 75), 6) AS evening_max FROM l GROUP BY 1, 2""")
def b11(spark, d):
    s = G.day_summary(areas(spark, d), ["area"])
    return out(s, ["area", "local_day"], *s.columns[2:])


@query("B12_hour_vectors", f"WITH {SERIES}, l AS (SELECT {DAY} AS local_day, {MTU} AS m, v FROM series) SELECT local_day, {_HOURS} FROM l GROUP BY 1")
def b12(spark, d):
    m = G.day_matrix(series(spark, d), [], slots=24)
    return out(m, ["local_day"], *m.columns[1:])


@query("B13_as_of_quotes", f"""WITH {SERIES}, q AS (SELECT o_orderdate + INTERVAL 8401 DAY AS ts, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1)
SELECT s.ts, round(q.price, 6) AS price FROM series s ASOF LEFT JOIN q ON s.ts >= q.ts""")
def b13(spark, d):
    quotes = table(spark, d, "orders").groupBy(T.plus(T.utc(F.col("o_orderdate")), days=8400).alias("ts")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    return out(G.as_of(series(spark, d), quotes, [], "price", lag_days=1), ["ts"], "price")


@query("B14_net_transfer", f"""WITH {AREA_GRID},
f AS (SELECT area, ts, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY area ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS v FROM grid)
SELECT ts, round(sum(CASE WHEN area IN ('click', 'view') THEN v ELSE -v END), 4) AS net FROM f GROUP BY ts""")
def b14(spark, d):
    g = G.on_grid(areas(spark, d), ["area"])
    v = F.coalesce(G.forward_fill(g, ["area"]), F.lit(0.0))
    signed = g.withColumn("x", F.when(F.col("area").isin("click", "view"), v).otherwise(-v))
    return signed.groupBy("ts").agg(rounded(F.sum("x"), 4).alias("net"))


@query("B15_interval_load", f"""WITH {INTERVALS},
s AS (SELECT kind, unnest(generate_series("start", "end" - INTERVAL 1 SECOND, INTERVAL 1 DAY)) AS ts, mw FROM intervals)
SELECT kind, ts, round(sum(mw), 6) AS mw FROM s GROUP BY 1, 2""")
def b15(spark, d):
    return out(G.interval_load(intervals(spark, d), ["kind"], "mw", minutes=1440), ["kind", "ts"], "mw")


@query("B18_strict_totals", f"WITH {AREAS}, w AS (SELECT ts, max(v) FILTER (area = 'click') AS a, max(v) FILTER (area = 'view') AS b, max(v) FILTER (area = 'error') AS c FROM areas GROUP BY ts) SELECT ts, round(a + b, 6) AS two, round(a + b + c, 6) AS three FROM w")
def b18(spark, d):
    w = areas(spark, d).groupBy("ts").pivot("area", ["click", "view", "error"]).agg(F.max("v"))
    a, b, c = (F.col(x) for x in ("click", "view", "error"))
    return w.select("ts", rounded(strict_sum(a, b)).alias("two"), rounded(strict_sum(a, b, c)).alias("three"))


@query("B23_step_flux", f"""WITH {AREAS}, n AS (SELECT area, {DAY} AS day, ts, v, row_number() OVER (PARTITION BY area, {DAY} ORDER BY ts)::DOUBLE AS t FROM areas),
s AS (SELECT area, ts, (v * t - lag(v * t) OVER w) / (t - lag(t) OVER w) AS x FROM n WINDOW w AS (PARTITION BY area, day ORDER BY t))
SELECT area, ts, round(CASE WHEN x IS NULL THEN NULL ELSE greatest(x, 0) END, 6) AS v FROM s""")
def b23(spark, d):
    from pyspark.sql import Window

    day = T.local_day(F.col("ts"))
    a = areas(spark, d).withColumn("day", day)
    a = a.withColumn("t", F.row_number().over(Window.partitionBy("area", "day").orderBy("ts")).cast("double"))
    return out(G.step_mean(a, ["area", "day"], "v", "t"), ["area", "ts"], "v")


@query("B24_run_fallback", """WITH t AS (SELECT DISTINCT date_trunc('hour', ts) AS requested FROM events), r AS (SELECT DISTINCT time_bucket(INTERVAL 3 HOUR, ts) AS run FROM events WHERE event_type = 'error')
SELECT requested, max(run) AS run FROM t JOIN r ON run <= requested AND run >= requested - INTERVAL 9 HOUR GROUP BY 1""")
def b24(spark, d):
    e = table(spark, d, "events")
    hour = F.date_trunc("hour", T.utc(F.col("ts"))).cast("timestamp_ntz")
    three = T.plus(hour, hours=0) - F.make_dt_interval(hours=F.hour(hour) % 3)
    runs = e.where("event_type = 'error'").select(three.cast("timestamp_ntz").alias("run")).distinct()
    # A run serves the ten hours that may fall back to it: an equi-join instead of a range join.
    served = runs.select("run", F.explode(F.sequence(F.col("run"), T.plus(F.col("run"), hours=9), F.make_dt_interval(hours=F.lit(1)))).alias("requested"))
    return e.select(hour.alias("requested")).distinct().join(served, "requested").groupBy("requested").agg(F.max("run").alias("run"))


@query("B25_merge_covariates", f"WITH {AREAS}, a AS (SELECT ts, v AS click FROM areas WHERE area = 'click'), b AS (SELECT ts, v AS error FROM areas WHERE area = 'error') SELECT ts, round(click, 6) AS click, round(error, 6) AS error FROM a FULL JOIN b USING (ts)")
def b25(spark, d):
    a = areas(spark, d)
    parts = [a.where(F.col("area") == k).select("ts", F.col("v").alias(k)) for k in ("click", "error")]
    return out(parts[0].join(parts[1], "ts", "full_outer"), ["ts"], "click", "error")


@query("B26_ramps", f"WITH {AREA_GRID} SELECT area, ts, round(v - lag(v, 4) OVER w, 6) AS v_ramp_4, round(v - lag(v, 12) OVER w, 6) AS v_ramp_12 FROM grid WINDOW w AS (PARTITION BY area ORDER BY ts)")
def b26(spark, d):
    return out(G.ramps(G.on_grid(areas(spark, d), ["area"]), ["area"]), ["area", "ts"], "v_ramp_4", "v_ramp_12")
