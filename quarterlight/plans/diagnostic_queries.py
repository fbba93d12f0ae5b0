"""Queries on groups of rows and features: corrections by ten groupings, residual diagnostics, feature rules, importance of clusters, scaling by kind."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features as N
from ..functions import time as T
from ..functions.numeric import rounded_up
from ..operators import folds as M
from ..operators import groups as G
from ..operators import linear as R
from ..operators import scaling as S
from ..sources.files import settle
from .frames import DAY, LOCAL, MTU, PANEL, clusters, out, panel, query, series, table

_ROWS = f"""x AS (SELECT ts, model, {DAY} AS day, hour({LOCAL})::INTEGER AS hour, {MTU} AS mtu, CASE WHEN (dayofweek({LOCAL}) + 6) % 7 >= 5 THEN 'weekend' ELSE 'weekday' END AS kind, y_pred, y_true, y_pred - y_true AS e FROM panel),
past AS (SELECT f.model, f.day, b.hour, b.mtu, b.kind, b.y_pred, b.e FROM (SELECT DISTINCT model, day FROM x) f JOIN x b ON b.model = f.model AND b.day BETWEEN f.day - 7 AND f.day - 1),
own AS (SELECT model, day, count(*) AS c, avg(e) AS g, list_transform(quantile_cont(y_pred, [0, 0.25, 0.5, 0.75, 1]), lambda q: round(q + 1e-9, 6)) AS q FROM past GROUP BY 1, 2),
edges AS (SELECT model, day, c, g, CASE WHEN c >= 4 AND len(list_distinct(q)) >= 3 THEN list_sort(list_distinct(q))[2:-2] END AS q FROM own)"""
_LABEL = "CASE WHEN q IS NULL THEN 'all' ELSE len(list_filter(q, lambda z: z < y_pred))::VARCHAR END"
_KEYS = {
    "none": "'none'", "global": "'global'", "hour": "hour::VARCHAR", "mtu": "mtu::VARCHAR", "daytype_hour": "kind || '_h' || hour", "daytype_mtu": "kind || '_m' || mtu",
    "prediction_bin": "label", "hour_prediction_bin": "hour || '_b' || label", "mtu_prediction_bin": "mtu || '_b' || label", "daytype_prediction_bin": "kind || '_b' || label",
}
_CASE = "CASE grouping " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _KEYS.items()) + " END"
_NAMES = "names AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in _KEYS) + "]) AS grouping)"
_CORRECTED = f"""{_ROWS}, {_NAMES},
rowsk AS (SELECT ts, model, day, y_pred, y_true, c, g, grouping, {_CASE} AS grp FROM (SELECT x.*, c, g, {_LABEL} AS label FROM x LEFT JOIN edges USING (model, day)), names),
st AS (SELECT model, day, grouping, grp, avg(e) AS m, count(*) AS n FROM (SELECT model, day, grouping, e, {_CASE} AS grp FROM (SELECT past.*, {_LABEL} AS label FROM past JOIN edges USING (model, day)), names) GROUP BY 1, 2, 3, 4),
fixed AS (SELECT r.*, CASE WHEN grouping = 'none' OR coalesce(c, 0) < 12 THEN 0 WHEN n >= 12 THEN m ELSE g END AS correction FROM rowsk r LEFT JOIN st USING (model, day, grouping, grp))"""


def _corrected(spark, d):
    p = settle(panel(spark, d).withColumn("day", T.local_day(F.col("ts"))))
    return G.corrections(p, ["model"], G.GROUPINGS, 7, 12, 4, 0.5)


@query("H5_group_corrections", f"""WITH {PANEL}, {_CORRECTED} SELECT ts, model, grouping, grp AS "group", round(correction + 1e-9, 5) AS correction, round(greatest(0, y_pred - 0.5 * correction) + 1e-9, 5) AS y_corrected FROM fixed""")
def h5_groups(spark, d):
    """Every row under each of ten groupings, corrected by its group's mean error in the week before."""
    c = _corrected(spark, d)
    return c.select("ts", "model", "grouping", "group", *[rounded_up(F.col(x), 5).alias(x) for x in ("correction", "y_corrected")])


@query("H5_grouping_scores", f"""WITH {PANEL}, {_CORRECTED}, s AS (SELECT model, grouping, count(*) AS n, count(DISTINCT grp) AS groups, avg(abs(greatest(0, y_pred - 0.5 * correction) - y_true)) AS mae FROM fixed GROUP BY 1, 2)
SELECT model, grouping, n, groups, round(mae + 1e-9, 5) AS mae, row_number() OVER (PARTITION BY model ORDER BY round(mae, 7), grouping)::INTEGER AS rank FROM s""")
def h5_scores(spark, d):
    """Which grouping corrects a model best: one job for all ten."""
    c = _corrected(spark, d).groupBy("model", "grouping").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group").alias("groups"), F.avg(F.abs(F.col("y_corrected") - F.col("y_true"))).alias("mae"))
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.round("mae", 7), "grouping"))
    return c.select("model", "grouping", "n", "groups", rounded_up(F.col("mae"), 5).alias("mae"), rank.alias("rank"))


_BINNED = {"actual_bin": "y_true", "prediction_bin": "y_pred", "actual_ramp_1h_bin": "r1", "actual_ramp_3h_bin": "r3"}
_LEVELS = {"hour": f"hour({LOCAL})::VARCHAR", "mtu": f"({MTU})::VARCHAR", "month": f"strftime({LOCAL}, '%Y-%m')", "weekday": f"dayname({LOCAL})", "daytype": f"CASE WHEN (dayofweek({LOCAL}) + 6) % 7 >= 5 THEN 'weekend' ELSE 'weekday' END"}
_DIAGNOSTICS = (
    """r AS (SELECT p.*, abs(p.y_true - a.y_true) AS r1, abs(p.y_true - b.y_true) AS r3 FROM panel p LEFT JOIN panel a ON a.model = p.model AND a.ts = p.ts - INTERVAL 1 HOUR LEFT JOIN panel b ON b.model = p.model AND b.ts = p.ts - INTERVAL 3 HOUR),
long AS ("""
    + " UNION ALL ".join(f"SELECT model, '{k}' AS dimension, {c}::DOUBLE AS v, y_pred - y_true AS e FROM r" for k, c in _BINNED.items())
    + """),
q AS (SELECT model, dimension, count(v) AS n, list_transform(quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1]), lambda z: round(z + 1e-9, 6)) AS q FROM long WHERE v IS NOT NULL GROUP BY 1, 2),
ed AS (SELECT model, dimension, CASE WHEN n >= 5 AND len(list_distinct(q)) >= 3 THEN list_sort(list_distinct(q))[2:-2] END AS q FROM q),
lv AS ("""
    + " UNION ALL ".join(f"SELECT model, '{k}' AS dimension, {v} AS level, y_pred - y_true AS e FROM r" for k, v in _LEVELS.items())
    + """ UNION ALL SELECT model, dimension, CASE WHEN q IS NULL THEN 'all' WHEN v IS NULL THEN 'missing' ELSE len(list_filter(q, lambda z: z < v))::VARCHAR END, e FROM long LEFT JOIN ed USING (model, dimension))"""
)


@query("J14_all_diagnostics", f"""WITH {PANEL}, {_DIAGNOSTICS} SELECT model, dimension, level, round(avg(abs(e)) + 1e-9, 5) AS mae, round(sqrt(avg(e * e)) + 1e-9, 5) AS rmse, round(avg(e) + 1e-9, 5) AS bias, round(CASE model WHEN 'naive_d1' THEN sqrt(avg(e * e)) / 4 END + 1e-9, 5) AS nrmse_pct, count(e) AS n_obs FROM lv GROUP BY 1, 2, 3""")
def j14_all(spark, d):
    """Errors by five divisions of time and by quantile bins of level and ramp."""
    m = G.residual_diagnostics(settle(panel(spark, d)), ["model"], 5, capacity={"naive_d1": 400.0})
    return m.select("model", "dimension", "level", *[rounded_up(F.col(c), 5).alias(c) for c in ("mae", "rmse", "bias", "nrmse_pct")], "n_obs")


# Names such as a price model's columns have, from the clusters, hours and weekdays that the events have.
_TEMPLATES = [
    "wind_speed_cluster_{c}_h{h}", "Wind_Speed_cluster_{c}_h{h}", "ssrd_cluster_{c}_h{h}", "sw_dir_cluster_{c}_h{h}", "sw_dif_cluster_{c}_h{h}", "t2m_cluster_{c}_h{h}", "price_d1_h{h}", "price_d2_h{h}",
    "price_d7_h{h}", "load_d0_h{h}", "exaa_h{h}", "EXAA_spread_h{h}", "reserve_fcr_h{h}", "Residual_Load_Proxy_MW_ramp_h{h}", "Residual_Load_Proxy_MW_h{h}", "Renewable_Wind_h{h}",
    "Renewable_Solar_h{h}", "Renewable_Total_h{h}", "rl_hat_h{h}", "weekday_{w}", "is_holiday", "is_15min_market", "month_sin", "{e}",
]


def _sql_rules(name: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, '{p}') THEN '{g}'" for p, g in rules) + f" ELSE '{default}' END"


_FEATURES = "k AS (SELECT DISTINCT (user_id % 8)::VARCHAR AS c, lpad(hour(ts)::VARCHAR, 2, '0') AS h, ((dayofweek(ts) + 6) % 7)::VARCHAR AS w, event_type AS e FROM events), names AS (" + " UNION ".join(
    "SELECT " + "replace(replace(replace(replace('" + t + "', '{c}', c), '{h}', h), '{w}', w), '{e}', e) AS feature FROM k" for t in _TEMPLATES
) + ")"


@query("I2_feature_rules", f"""WITH {_FEATURES} SELECT feature, {_sql_rules('lower(feature)', N.FEATURE_GROUPS, 'Other')} AS grp, {_sql_rules('lower(feature)', N.IMPORTANCE_GROUPS, 'Other')} AS importance_group, {_sql_rules('feature', N.SUBGROUPS, 'Calendar/other')} AS subgroup,
 nullif(regexp_extract(lower(feature), 'wind_speed_cluster_([0-9]+)_h[0-9]+', 1), '')::INTEGER AS wind_cluster, CASE WHEN regexp_matches(lower(feature), 'ssrd|sw_dir|sw_dif') THEN nullif(regexp_extract(lower(feature), 'cluster_([0-9]+)_h[0-9]+', 1), '')::INTEGER END AS solar_cluster FROM names""")
def i2_rules(spark, d):
    """Groups, subgroups and clusters of feature names by the ordered rules of ``functions/features.py``."""
    ts = F.col("ts")
    parts = {"{c}": (F.col("user_id") % 8).cast("string"), "{h}": F.lpad(F.hour(ts).cast("string"), 2, "0"), "{w}": F.weekday(ts).cast("string"), "{e}": F.col("event_type")}
    keys = table(spark, d, "events").select(*[v.alias(k[1]) for k, v in parts.items()]).distinct()
    name = F.explode(F.array(*[F.lit(t) for t in _TEMPLATES]))
    n = keys.withColumn("feature", name)
    for k in parts:
        n = n.withColumn("feature", F.replace("feature", F.lit(k), F.col(k[1])))
    n, f = n.select("feature").distinct(), F.col("feature")
    return n.select(f, N.feature_group(f).alias("grp"), N.importance_group(f).alias("importance_group"), N.subgroup(f).alias("subgroup"), N.wind_cluster(f).alias("wind_cluster"), N.solar_cluster(f).alias("solar_cluster"))


def cluster_contributions(spark, d):
    """ts, day, mtu, feature, contribution: a ridge of the hourly total on eight clusters' means a day before, and on its own lag."""
    names = {c: f"wind_speed_cluster_{c}_h0" for c in range(8)}
    here = F.col("ts")
    wide = clusters(spark, d).groupBy(T.plus(here, days=1).alias("ts")).pivot("cluster_id", list(range(8))).agg(F.first("v"))
    wide = wide.withColumnsRenamed({str(c): n for c, n in names.items()})
    hour = F.date_trunc("hour", here).cast("timestamp_ntz")
    y = series(spark, d).groupBy(hour.alias("ts")).agg(F.sum("v").alias("y"))
    lag = y.select(T.plus(here, days=1).alias("ts"), F.col("y").alias("price_d1_h0"))
    rows = settle(y.join(wide, "ts").join(lag, "ts").withColumn("day", T.local_day(here)).withColumn("mtu", T.mtu(here)))
    x = [*names.values(), "price_d1_h0"]
    return R.contributions(rows, R.fit_windows(rows, x, "y", 7, 40), x)


@query("I3_cluster_importance")
def i3_clusters(spark, d):
    """Mean absolute contribution of each wind cluster between 08:00 and 20:00, and of all features by group."""
    c = settle(cluster_contributions(spark, d).select("ts", "mtu", F.col("feature"), "contribution"))
    by_cluster = G.group_importance(c.where("mtu BETWEEN 32 AND 79").withColumn("grp", N.wind_cluster(F.col("feature")).cast("string")), ["ts"], "grp").withColumn("kind", F.lit("wind_cluster"))
    by_group = G.group_importance(c.withColumn("grp", N.feature_group(F.col("feature"))), ["ts"], "grp").withColumn("kind", F.lit("group"))
    return out(by_cluster.unionByName(by_group), ["kind", "grp"], "n", "mean_abs", "median_abs", "share")


# Features of each kind from the events: an event type's hourly sum under a name of the kind, and marks of the weekday.
_KINDS = {"click": "price_d1_h0", "view": "wind_speed_cluster_0_h0", "error": "ssrd_cluster_0_h0", "purchase": "load_d0_h0", "signup": "spread_h0"}
_KIND_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
_LONG = f"""hr AS (SELECT date_trunc('hour', ts) AS ts, event_type, round(sum(value), 4) AS v FROM events GROUP BY 1, 2),
long AS (SELECT ts, {DAY} AS day, feature, value FROM (
  SELECT ts, {_KIND_CASE} AS feature, v AS value FROM hr UNION ALL SELECT ts, 'sw_dir_cluster_0_h0', CASE WHEN v > 600 THEN v - 600 ELSE 0 END FROM hr WHERE event_type = 'error'
  UNION ALL SELECT ts, 'weekday_0', (dayofweek({LOCAL}) = 1)::INTEGER::DOUBLE FROM hr WHERE event_type = 'view' UNION ALL SELECT ts, 'flat_h0', 3 FROM hr WHERE event_type = 'view') WHERE feature IS NOT NULL)"""


def kind_rows(spark, d):
    """ts, day, feature, value: hourly features of each kind."""
    here = F.col("ts")
    hr = table(spark, d, "events").groupBy(F.date_trunc("hour", T.utc(here)).cast("timestamp_ntz").alias("ts"), "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    is_type = lambda t: F.col("event_type") == t
    pair = lambda when, name, v: F.when(when, F.struct(F.lit(name).alias("feature"), v.cast("double").alias("value")))
    found = [pair(is_type(k), n, F.col("v")) for k, n in _KINDS.items()]
    found += [pair(is_type("error"), "sw_dir_cluster_0_h0", F.greatest(F.col("v") - 600, F.lit(0.0))), pair(is_type("view"), "weekday_0", (F.weekday(T.local(here)) == 0).cast("double")), pair(is_type("view"), "flat_h0", F.lit(3.0))]
    return hr.select("ts", T.local_day(here).alias("day"), F.explode(F.array_compact(F.array(*found))).alias("_x")).select("ts", "day", "_x.feature", "_x.value")


@query("G3_scaled_kinds", f"""WITH {_LONG}, tr AS (SELECT f.day AS fold, b.ts, b.feature, b.value FROM (SELECT DISTINCT feature, day FROM long) f JOIN long b ON b.feature = f.feature AND b.day BETWEEN f.day - 7 AND f.day - 1),
m AS (SELECT fold, feature, count(*) AS n, min(value) AS lo, max(value) AS hi, median(value) AS center, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg((value > 0)::INTEGER) AS share FROM tr GROUP BY 1, 2 HAVING count(*) >= 48),
a AS (SELECT fold, feature, median(abs(value - center)) AS mad FROM tr JOIN m USING (fold, feature) GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN mad > 1e-12 THEN mad / 0.6744897501960817 ELSE 1 END AS scale FROM m JOIN a USING (fold, feature)),
r AS (SELECT fold, 'train' AS split, ts, feature, value FROM tr UNION ALL SELECT day, 'test', ts, feature, value FROM long)
SELECT fold, split, ts, feature, round(CASE WHEN feature LIKE 'price%' THEN asinh((value - center) / scale) WHEN feature LIKE 'wind%' OR feature LIKE 'load%' THEN (value - center) / scale WHEN feature LIKE 'weekday%' THEN value
  WHEN regexp_matches(feature, 'ssrd|sw_dir') AND (hi - lo < 20 OR share < 0.5) THEN 0 ELSE (value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END END + 1e-9, 5) AS scaled FROM r JOIN s USING (fold, feature)""")
def g3_kinds(spark, d):
    """Training and test rows of every delivery day, each feature scaled by its kind with the training week's constants."""
    rows = settle(kind_rows(spark, d))
    both = M.rolling_folds(rows, "day", 7, 1).select("fold", "split", "ts", "feature", "value")
    s = S.scale_by_kind(both, S.window_scales(rows, [], 7, 48), [])
    return s.select("fold", "split", "ts", "feature", rounded_up(F.col("scaled"), 5).alias("scaled"))
