"""Source, cache, sink and streaming queries (families A and K), and reshaping that reads landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as H
from ..functions import text as X
from ..functions import time as T
from ..functions.numeric import rounded, rounded_up
from ..operators import evaluation as E
from ..operators import grid as G
from ..operators.clustering import dominant
from ..operators.grid import keep_last
from ..sources import files as S
from ..streaming import streams as R
from .frames import AREAS, CLUSTERS, DAY, LOCAL, PANEL, SERIES, areas, clusters, out, panel, query, series, table


@query("A2_offset_timestamps", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 1 HOUR END AS ts FROM events")
def a2(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    third = F.col("event_id") % 3
    e = table(spark, d, "events").select("event_id", F.when(third == 0, F.concat(text, F.lit("Z"))).when(third == 1, F.concat(text, F.lit("+02:00"))).otherwise(text).alias("raw"))
    return e.select("event_id", S.parse_instant(F.col("raw"), T.ZONE).alias("ts"))


@query("A3_required_columns", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def a3(spark, d):
    return out(S.require(table(spark, d, "events"), "event_id", "event_type", "value"), ["event_id", "event_type"], "value")


@query("A4_positive_weights", "SELECT c_nationkey AS region, round(sum(c_acctbal), 2) AS weight FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1 HAVING sum(c_acctbal) > 0")
def a4(spark, d):
    c = S.scan(spark, f"{d}/customer.parquet").select(F.col("c_nationkey").alias("region"), "c_acctbal")
    return S.positive_weights(c, "region", "c_acctbal").withColumn("weight", rounded(F.col("weight"), 2))


@query("A5_pruned_scan", "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part WHERE p_size > 40")
def a5(spark, d):
    return out(table(spark, d, "part").where("p_size > 40").select("p_partkey", "p_retailprice"), ["p_partkey"], "p_retailprice")


_SKIPPED = ("2024-01-13", "2024-01-20")


@query("A6_issue_folders", f"""WITH q AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, (user_id % 8)::INTEGER AS cluster_id, round(avg(value), 4) AS v FROM events GROUP BY 1, 2), {CLUSTERS},
l AS (SELECT ts, cluster_id, 'ghi' AS variable, v FROM q UNION ALL SELECT ts, cluster_id, 't2m', v FROM clusters),
r AS (SELECT ts::DATE AS issue_day, ts + INTERVAL 1 DAY AS valid, cluster_id, variable, v FROM l WHERE hour(ts) // 6 = 1 AND ts::DATE >= DATE '2024-01-10' AND ts::DATE NOT IN (DATE '{_SKIPPED[0]}', DATE '{_SKIPPED[1]}'))
SELECT issue_day, valid, cluster_id, max(v) FILTER (variable = 't2m') AS t2m, max(v) FILTER (variable = 'ghi') AS ghi, minute(valid) = 0 AS hourly FROM r
WHERE valid >= issue_day::TIMESTAMP + INTERVAL 23 HOUR AND valid < issue_day::TIMESTAMP + INTERVAL 47 HOUR GROUP BY 1, 2, 3""")
def a6(spark, d):
    """Forecast folders by issue day and run: pruned, without skipped days, flux stamps moved to the step's begin, variables merged by time, clipped to the delivery day."""
    q = table(spark, d, "events").groupBy(T.bucket(F.col("ts")).alias("ts"), (F.col("user_id") % 8).cast("int").alias("cluster_id")).agg(F.round(F.avg("value"), 4).alias("v"))
    flux = q.select(F.lit("ghi").alias("variable"), "ts", T.plus(F.col("ts"), mins=15).alias("stamp"), "cluster_id", "v")  # a flux lands with the end of its step
    state = clusters(spark, d).select(F.lit("t2m").alias("variable"), "ts", F.col("ts").alias("stamp"), "cluster_id", "v")
    landed = flux.unionByName(state).select("variable", F.col("ts").cast("date").alias("issue_day"), (F.floor(F.hour("ts") / 6) * 6).cast("int").alias("run"), T.plus(F.col("stamp"), days=1).alias("stamp"), "cluster_id", "v")
    return S.issue_folders(S.write_partitions(landed, S.shared_folder(spark), "issue_day", "run"), 6, "2024-01-10", _SKIPPED, ["t2m"], ["ghi"])


@query("A7_variable_aliases", "SELECT event_type AS raw, CASE event_type WHEN 'click' THEN 't2m' WHEN 'view' THEN 'ghi' WHEN 'error' THEN 'u10' ELSE lower(event_type) END AS variable, count(*) AS n FROM events GROUP BY 1, 2")
def a7(spark, d):
    names = F.create_map(F.lit("click"), F.lit("t2m"), F.lit("view"), F.lit("ghi"), F.lit("error"), F.lit("u10"))
    raw = F.col("event_type")
    return table(spark, d, "events").groupBy(raw.alias("raw"), F.coalesce(names[raw], X.label(raw)).alias("variable")).agg(F.count(F.lit(1)).alias("n"))


@query("A8_yearly_union", """WITH p AS (SELECT year(o_orderdate) AS y, o_orderdate AS ts, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2), s AS (SELECT year(l_shipdate) AS y, l_shipdate AS ts, avg(l_quantity) AS wind FROM lineitem GROUP BY 1, 2)
SELECT coalesce(p.ts, s.ts) AS ts, round(price + 1e-9, 4) AS price, round(wind + 1e-9, 4) AS wind FROM p FULL JOIN s ON p.y = s.y AND p.ts = s.ts""")
def a8(spark, d):
    """Two directories of yearly tables, one per variable: all years of each, joined by time; the first of equal times stays."""
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), T.utc(F.col("o_orderdate")).alias("ts")).agg(F.avg("o_totalprice").alias("price"))
    li = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y"), T.utc(F.col("l_shipdate")).alias("ts")).agg(F.avg("l_quantity").alias("wind"))
    parts = [G.keep_last(S.write_partitions(x, S.shared_folder(spark), "y"), ["ts"], "y", first=True).drop("y") for x in (o, li)]
    return parts[0].join(parts[1], "ts", "full_outer").select("ts", rounded_up(F.col("price"), 4).alias("price"), rounded_up(F.col("wind"), 4).alias("wind"))


@query("A9_registry_xml", "SELECT s_suppkey AS id, s_nationkey::INTEGER AS nation, round(abs(s_acctbal) * 10 / 1000, 6) AS mw, s_nationkey % 5 = 0 AS offshore FROM supplier WHERE s_nationkey < 20 AND s_acctbal <> 0")
def a9(spark, d):
    """Units landed as XML, read by row tag, filtered and converted from kW to MW."""
    path = S.shared_folder(spark)
    units = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), (F.abs("s_acctbal") * 10).alias("kw"))
    units.write.format("xml").option("rowTag", "unit").option("rootTag", "registry").save(path)
    read = spark.read.format("xml").option("rowTag", "unit").schema("id long, nation int, kw double").load(path)
    return read.where("nation < 20 AND kw > 0").select("id", "nation", rounded(F.col("kw") / 1000).alias("mw"), (F.col("nation") % 5 == 0).alias("offshore"))


@query("A10_incremental_cache", f"WITH {SERIES} SELECT ts, round(v + CASE WHEN {DAY} >= DATE '2024-01-20' THEN 1 ELSE 0 END, 6) AS v FROM series")
def a10(spark, d):
    s = series(spark, d)
    day = T.local_day(F.col("ts"))
    cached, fresh = s.where(day < F.lit("2024-01-23").cast("date")), s.where(day >= F.lit("2024-01-20").cast("date")).withColumn("v", F.col("v") + 1)
    return out(S.upsert(cached, fresh, ["ts"]), ["ts"], "v")


@query("A12_repair_days", f"WITH {SERIES}, b AS (SELECT {DAY} AS day FROM series GROUP BY 1 HAVING count(*) < 96) SELECT ts, round(v, 6) AS v, {DAY} IN (SELECT day FROM b) AS refreshed FROM series")
def a12(spark, d):
    s = series(spark, d).withColumn("day", T.local_day(F.col("ts")))
    short = s.groupBy("day").agg(F.count("v").alias("n")).where(F.col("n") < T.slots(F.col("day"))).select("day", F.lit(True).alias("refreshed"))
    return out(s.join(short, "day", "left").withColumn("refreshed", F.coalesce("refreshed", F.lit(False))), ["ts"], "v", "refreshed")


@query("A14_request_cache", f"WITH {AREAS} SELECT area, {DAY} AS day, ts, round(v, 6) AS v, area = 'click' AND {DAY} <= DATE '2024-01-12' AS hit FROM areas WHERE area IN ('click', 'view') AND {DAY} BETWEEN DATE '2024-01-08' AND DATE '2024-01-20'")
def a14(spark, d):
    """A cache keyed by area and day: one request fills it, a second finds some of its keys there and fetches the rest."""
    a = areas(spark, d).withColumn("day", T.local_day(F.col("ts")))
    path, keys = S.shared_folder(spark), ["area", "day"]
    wanted = lambda names, lo, hi: a.where(F.col("area").isin(names) & F.col("day").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).select(*keys).distinct()
    fetch = lambda missing: a.join(missing, keys, "left_semi")
    S.request(spark, path, wanted(["click"], "2024-01-01", "2024-01-12"), keys, fetch)
    return out(S.request(spark, path, wanted(["click", "view"], "2024-01-08", "2024-01-20"), keys, fetch), [*keys, "ts"], "v", "hit")


@query("A16_allow_list", "SELECT o_orderkey, o_orderstatus FROM orders")
def a16(spark, d):
    """The columns that a file allows for a target, under one of its names."""
    path = S.shared_folder(spark)
    lines = ["# target, feature", "wind, o_orderkey", "solar, o_totalprice", "wind, not_there", "", "*, o_orderstatus"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    o = table(spark, d, "orders")
    return o.select(*[c for c in S.allow_list(spark, path, "wind_onshore", {"wind_onshore": "wind"}) if c in o.columns])


@query("A17_output_bundle", f"""WITH {PANEL}, e AS (SELECT model, strftime({LOCAL}, '%Y-%m') AS month, y_pred - y_true AS e FROM panel),
m AS (SELECT model, month AS period, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, count(*) AS n FROM e GROUP BY 1, 2 UNION ALL SELECT model, 'full', avg(abs(e)), sqrt(avg(e * e)), avg(e), count(*) FROM e GROUP BY 1)
SELECT model, period, round(mae, 5) AS mae, round(rmse, 5) AS rmse, round(bias, 5) AS bias, n AS n_obs, n AS forecast_rows, 'naive' AS experiment, (SELECT count(DISTINCT {DAY}) FROM panel) AS runtime_rows FROM m""")
def a17(spark, d):
    """Forecast by month, runtime rows, metrics full and by month, and the configuration, written as one bundle and read back."""
    p = panel(spark, d)
    runtime = p.select(T.local_day(F.col("ts")).alias("day")).distinct().withColumn("seconds", F.lit(0.0))
    b = S.write_bundle(p.withColumn("month", F.date_format(T.local(F.col("ts")), "yyyy-MM")), runtime, E.monthly_metrics(p).withColumnRenamed("month", "period"), {"experiment": "naive", "days": [1, 7]}, S.shared_folder(spark))
    counts = b["forecast"].groupBy("model", F.col("month").alias("period")).agg(F.count(F.lit(1)).alias("forecast_rows"))
    counts = counts.unionByName(b["forecast"].groupBy("model").agg(F.count(F.lit(1)).alias("forecast_rows")).withColumn("period", F.lit("full")))
    days = b["runtime"].agg(F.count(F.lit(1)).alias("runtime_rows"))
    found = b["metrics"].join(counts, ["model", "period"]).crossJoin(F.broadcast(b["config"].select("experiment"))).crossJoin(F.broadcast(days))  # one row each
    return found.select("model", "period", *[rounded(F.col(c), 5).alias(c) for c in ("mae", "rmse", "bias")], "n_obs", "forecast_rows", "experiment", "runtime_rows")


@query("A18_metadata_row", f"WITH {AREAS} SELECT area, round(sum(v), 3) AS total, count(*) AS rows, (SELECT count(*) FROM areas) AS table_rows, (SELECT min(ts) FROM areas) AS \"start\", (SELECT max(ts) FROM areas) AS \"end\", (SELECT count(DISTINCT area) FROM areas) AS areas FROM areas GROUP BY area")
def a18(spark, d):
    """A feature table by area with a summary beside it and one JSON row of metadata, all read back."""
    path = S.shared_folder(spark)
    a = S.write_partitions(areas(spark, d), f"{path}/features", "area")
    a.groupBy("area").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("rows")).write.csv(f"{path}/summary", header=True)
    m = a.agg(F.count(F.lit(1)).alias("table_rows"), F.min("ts").cast("string").alias("start"), F.max("ts").cast("string").alias("end"), F.size(F.collect_set("area")).cast("long").alias("areas"))
    m.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/metadata")
    meta = spark.read.schema("table_rows long, start timestamp_ntz, end timestamp_ntz, areas long").json(f"{path}/metadata")
    summary = spark.read.schema("area string, total double, rows long").csv(f"{path}/summary", header=True)
    return summary.crossJoin(F.broadcast(meta)).withColumn("total", rounded(F.col("total"), 3))  # one row of metadata


@query("A19_cell_map", f"WITH {CLUSTERS} SELECT 'v' AS variable, cluster_id, count(*) AS n, round(avg(v), 4) AS mean FROM clusters GROUP BY 2")
def a19(spark, d):
    """Cell to cluster map and one aggregated series per variable, written by variable and day."""
    c = clusters(spark, d).select(F.lit("v").alias("variable"), F.col("ts").cast("date").alias("issue_day"), "ts", "cluster_id", "v")
    back = S.write_partitions(c, S.shared_folder(spark), "variable", "issue_day")
    return back.groupBy("variable", "cluster_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("v"), 4).alias("mean"))


@query("A22_reuse_or_rebuild", f"WITH {AREAS}, a AS (SELECT ts, v AS click FROM areas WHERE area = 'click'), b AS (SELECT ts, v AS purchase FROM areas WHERE area = 'purchase') SELECT ts, round(click, 6) AS click, round(purchase, 6) AS purchase FROM a FULL JOIN b USING (ts)")
def a22(spark, d):
    """A stored table that lacks a column is rebuilt by an outer join; the next call reuses it."""
    a, path, columns = areas(spark, d), S.shared_folder(spark), ["ts", "click", "purchase"]
    part = lambda k: a.where(F.col("area") == k).select("ts", F.col("v").alias(k))
    part("click").write.parquet(path)
    build = lambda: part("click").join(part("purchase"), "ts", "full_outer")
    _, reused = S.reuse_or_build(spark, path, columns, build)
    found, again = S.reuse_or_build(spark, path, columns, build)
    if reused or not again:
        raise RuntimeError("the first call builds and the second reuses")
    return out(found, ["ts"], "click", "purchase")


_PRODUCTS = "prod AS (SELECT o_orderdate::DATE AS day, CASE o_orderstatus WHEN 'F' THEN 'POS' ELSE 'NEG' END AS direction, (o_orderkey % 6)::INTEGER * 4 AS h, o_totalprice AS price FROM orders)"


def products(spark, d):
    """day, product (like POS_04_08), price as German text."""
    o = table(spark, d, "orders")
    h = (F.col("o_orderkey") % 6).cast("int") * 4
    name = F.format_string("%s_%02d_%02d", F.when(F.col("o_orderstatus") == "F", "POS").otherwise("NEG"), h, h + 4)
    return o.select(F.col("o_orderdate").cast("date").alias("day"), name.alias("product"), F.regexp_replace(F.format_string("%.2f", "o_totalprice"), "\\.", ",").alias("price"))


@query("B16_reserve_blocks", f"WITH {_PRODUCTS} SELECT day, m.mtu::INTEGER AS mtu, round(sum(round(price, 2)) FILTER (direction = 'POS'), 2) AS pos, round(sum(round(price, 2)) FILTER (direction = 'NEG'), 2) AS neg FROM prod, range(16) m(k), LATERAL (SELECT h * 4 + m.k AS mtu) m GROUP BY 1, 2")
def b16(spark, d):
    p = products(spark, d).withColumn("v", X.german_number(F.col("price")))
    part = lambda k: F.regexp_extract("product", r"^(POS|NEG)_(\d{2})_(\d{2})$", k)
    p = p.select("day", part(1).alias("direction"), F.explode(F.sequence(part(2).cast("int") * 4, part(3).cast("int") * 4 - 1)).alias("mtu"), "v")
    w = p.groupBy("day", "mtu").pivot("direction", ["POS", "NEG"]).agg(F.sum("v"))
    return w.select("day", "mtu", rounded(F.col("POS"), 2).alias("pos"), rounded(F.col("NEG"), 2).alias("neg"))


_LAST_SUNDAY = "make_date(year(day - 1), {0}) - dayofweek(make_date(year(day - 1), {0}))::INTEGER"
# Summer time ended in September up to 1995.
_SUMMER = f"day - 1 >= {_LAST_SUNDAY.format('3, 31')} AND day - 1 < CASE WHEN year(day - 1) <= 1995 THEN {_LAST_SUNDAY.format('9, 30')} ELSE {_LAST_SUNDAY.format('10, 31')} END"


@query("B17_publication_time", f"WITH {_PRODUCTS} SELECT DISTINCT day, direction, day::TIMESTAMP - INTERVAL 1 DAY + CASE direction WHEN 'POS' THEN INTERVAL 8 HOUR ELSE INTERVAL 9 HOUR END - CASE WHEN {_SUMMER} THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS published FROM prod")
def b17(spark, d):
    times = F.when(F.col("direction") == "POS", 9).otherwise(10)  # local clock hours on the day before
    p = products(spark, d).select("day", F.substring("product", 1, 3).alias("direction")).distinct()
    local = F.date_sub(F.col("day"), 1).cast("timestamp_ntz") + F.make_dt_interval(hours=times)
    return p.select("day", "direction", F.convert_timezone(F.lit(T.ZONE), F.lit("UTC"), local).alias("published"))


@query("B19_units", f"WITH {CLUSTERS} SELECT ts, cluster_id, round(v + 273.15, 6) AS t2m_k, round((900 + v) * 100, 6) AS pressure_pa, round(v * 2 + coalesce(CASE WHEN cluster_id > 3 THEN v END, 0), 6) AS radiation FROM clusters")
def b19(spark, d):
    v = F.col("v")
    return clusters(spark, d).select("ts", "cluster_id", rounded(v + 273.15).alias("t2m_k"), rounded((900 + v) * 100).alias("pressure_pa"), rounded(v * 2 + F.coalesce(F.when(F.col("cluster_id") > 3, v), F.lit(0.0))).alias("radiation"))


@query("B20_wind_components", f"WITH {CLUSTERS} SELECT ts, cluster_id, round(-v * sin(radians(cluster_id * 40)), 6) AS u, round(-v * cos(radians(cluster_id * 40)), 6) AS w, round(v + 0.5 * (v * 1.2 - v), 6) AS s100 FROM clusters")
def b20(spark, d):
    v = F.col("v")
    u, w = H.wind_components(v, F.col("cluster_id") * 40.0)
    return clusters(spark, d).select("ts", "cluster_id", rounded(u).alias("u"), rounded(w).alias("w"), rounded(H.hub_speed(v, v * 1.2, F.lit(100.0))).alias("s100"))


@query("B21_sample_points", "WITH p AS (SELECT date_trunc('hour', ts) AS ts, user_id % 8 AS cluster_id, user_id AS point, avg(value) AS v FROM events GROUP BY 1, 2, 3) SELECT ts, cluster_id::INTEGER AS cluster_id, round(avg(v), 6) AS v, count(*) AS points FROM p GROUP BY 1, 2")
def b21(spark, d):
    hour = F.date_trunc("hour", T.utc(F.col("ts"))).cast("timestamp_ntz")
    p = table(spark, d, "events").groupBy(hour.alias("ts"), (F.col("user_id") % 8).cast("int").alias("cluster_id"), "user_id").agg(F.avg("value").alias("v"))
    return p.groupBy("ts", "cluster_id").agg(rounded(F.avg("v")).alias("v"), F.count(F.lit(1)).alias("points"))


@query("B22_spaced_points", """WITH r AS (SELECT user_id % 8 AS cluster_id, user_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY user_id) - 1 AS i, count(*) OVER (PARTITION BY user_id % 8) AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT cluster_id::INTEGER AS cluster_id, user_id FROM r WHERE n <= 4 OR i IN (SELECT round(k * ((r.n - 1) / 3.0::DOUBLE)) FROM range(4) t(k))""")
def b22(spark, d):
    from pyspark.sql import Window

    from ..operators.folds import evenly_spaced

    w = Window.partitionBy("cluster_id")
    u = table(spark, d, "events").select((F.col("user_id") % 8).cast("int").alias("cluster_id"), "user_id").distinct()
    u = u.withColumn("i", F.row_number().over(w.orderBy("user_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return u.where(evenly_spaced(F.col("n"), F.col("i"), 4)).select("cluster_id", "user_id")


@query("C1_column_patterns", "SELECT p_type, count(*) AS n FROM part WHERE regexp_matches(p_type, '^(STANDARD|SMALL|ECONOMY|A)') AND NOT regexp_matches(p_type, 'TIN$') GROUP BY 1")
def c1(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").where(t.rlike("^(STANDARD|SMALL|ECONOMY|A)") & ~t.rlike("TIN$")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("C2_feature_catalog", "WITH c AS (SELECT DISTINCT p_type AS feature, CASE WHEN p_type < 'M' THEN 'wind' ELSE 'solar' END AS target FROM part) SELECT c.target, p_type AS feature, round(avg(p_retailprice), 4) AS value FROM part JOIN c ON feature = p_type WHERE p_type NOT LIKE '%Actual%' GROUP BY 1, 2")
def c2(spark, d):
    p = table(spark, d, "part")
    catalog = p.select(F.col("p_type").alias("feature")).distinct().withColumn("target", F.when(F.col("feature") < "M", "wind").otherwise("solar"))
    own = p.where(~F.col("p_type").contains("Actual")).join(F.broadcast(catalog), F.col("p_type") == F.col("feature"))
    return own.groupBy("target", "feature").agg(rounded(F.avg("p_retailprice"), 4).alias("value"))


@query("C10_first_existing", "SELECT s_suppkey, round(coalesce(s_acctbal, 0), 6) AS value FROM supplier")
def c10(spark, d):
    s = table(spark, d, "supplier")
    known = [F.col(c) for c in ("capacity_mw", "s_acctbal", "c_acctbal") if c in s.columns]
    return s.select("s_suppkey", rounded(F.coalesce(*known, F.lit(0.0))).alias("value"))


@query("D13_registry_filter", "SELECT s_suppkey, r_name AS area, round(s_acctbal, 6) AS mw FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0 AND r_name <> 'AFRICA'")
def d13(spark, d):
    dim = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("area"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").join(F.broadcast(dim), F.col("s_nationkey") == F.col("n_nationkey")).where("area <> 'AFRICA'")
    return s.select("s_suppkey", "area", rounded(F.col("s_acctbal")).alias("mw"))


@query("D12_dominant_area", "WITH g AS (SELECT s_nationkey % 7 AS cell, n_regionkey AS area, sum(greatest(s_acctbal, 0)) AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT cell::INTEGER AS cell, area, round(w, 2) AS w FROM g QUALIFY row_number() OVER (PARTITION BY cell ORDER BY w DESC, area) = 1")
def d12(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select((F.col("s_nationkey") % 7).cast("int").alias("cell"), F.col("n_regionkey").alias("area"), F.greatest("s_acctbal", F.lit(0.0)).alias("x"))
    return dominant(s, "cell", "area", "x").withColumn("w", rounded(F.col("w"), 2))


@query("K1_stream_upsert", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def k1(spark, d):
    """Revisions by key and local day in versioned day partitions; a key's last row over its days."""
    events = R.event_stream(spark, d).select("user_id", "event_type", T.local_day(F.col("ts")).alias("day"), "event_id", "value")
    held = R.upsert_stream(events, ["user_id", "event_type"], "event_id")
    return out(keep_last(held, ["user_id", "event_type"], "event_id"), ["user_id", "event_type"], "event_id", "value")


@query("K2_stream_windows", "SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(sum(value), 4) AS v, count(*) AS n FROM events GROUP BY 1, 2")
def k2(spark, d):
    w = R.windowed_sums(R.event_stream(spark, d), "event_type", "value")
    return w.select("event_type", "ts", rounded(F.col("v"), 4).alias("v"), "n")


@query("K3_stream_cutoff", "SELECT event_id, (ts + INTERVAL 1 HOUR)::DATE + 1 AS delivery_day, round(value, 6) AS value FROM events WHERE (ts + INTERVAL 1 HOUR)::TIME <= TIME '10:00:00'")
def k3(spark, d):
    return out(R.collect_stream(R.before_cutoff(R.event_stream(spark, d)).select("event_id", "delivery_day", "value")), ["event_id", "delivery_day"], "value")


@query("K4_stream_completeness", "SELECT (ts + INTERVAL 1 HOUR)::DATE AS day, count(DISTINCT time_bucket(INTERVAL 15 MINUTE, ts))::INTEGER AS n, count(DISTINCT time_bucket(INTERVAL 15 MINUTE, ts)) >= 96 AS complete FROM events GROUP BY 1")
def k4(spark, d):
    return R.day_completeness(R.event_stream(spark, d)).select("day", "n", "complete")
