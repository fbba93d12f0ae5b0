"""Text, spatial and capacity queries (families C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions import time as T
from ..functions.numeric import rounded
from ..operators import capacity as P
from ..operators import spatial as S
from .frames import CLUSTERS, INTERVALS, clusters, intervals, out, query, table


@query("C3_labels", "SELECT DISTINCT o_orderpriority AS raw, trim(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '_') AS label FROM orders")
def c3(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("raw"), X.label(F.col("o_orderpriority")).alias("label")).distinct()


@query("C4_tokens", "SELECT p_type, array_to_string(list_filter(regexp_split_to_array(upper(p_type), '[^A-Z0-9]+'), lambda t: t <> '' AND (starts_with(t, 'S') OR starts_with(t, 'P'))), ',') AS tokens FROM (SELECT DISTINCT p_type FROM part)")
def c4(spark, d):
    return table(spark, d, "part").select("p_type").distinct().select("p_type", F.array_join(X.tokens_with_prefix(F.col("p_type"), ["S", "P"]), ",").alias("tokens"))


@query("C5_safe_ratio", "SELECT l_returnflag, l_linestatus, round(CASE WHEN sum(l_tax) > 1e-6 THEN sum(l_discount) / sum(l_tax) ELSE 0 END, 6) AS ratio FROM lineitem GROUP BY 1, 2")
def c5(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(rounded(N.safe_ratio(F.sum("l_discount"), F.sum("l_tax"))).alias("ratio"))


@query("C6_clip", "SELECT event_id, round(greatest(10, least(60, value)), 6) AS v FROM events")
def c6(spark, d):
    return table(spark, d, "events").select("event_id", rounded(N.clip(F.col("value"), 10.0, 60.0)).alias("v"))


@query("C7_asinh_scale", """WITH m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1), s AS (SELECT event_type, median(abs(value - c)) / 0.6745 AS s FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, round(asinh((value - c) / s), 6) AS z FROM events JOIN m USING (event_type) JOIN s USING (event_type)""")
def c7(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    m = e.groupBy("event_type").agg(F.median("value").alias("c"))
    s = e.join(F.broadcast(m), "event_type").groupBy("event_type").agg(F.first("c").alias("c"), (F.median(F.abs(F.col("value") - F.col("c"))) / 0.6745).alias("s"))
    return e.join(F.broadcast(s), "event_type").select("event_id", rounded(F.asinh((F.col("value") - F.col("c")) / F.col("s"))).alias("z"))


@query("C8_cyclic", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS s, round(cos(2 * pi() * hour(ts) / 24), 6) AS c FROM events")
def c8(spark, d):
    s, c = N.cyclic(F.hour("ts"), 24.0)
    return table(spark, d, "events").select("event_id", rounded(s).alias("s"), rounded(c).alias("c"))


@query("C9_logistic", "SELECT event_id, round(1 / (1 + exp(-greatest(-40, least(40, (value - 50) / 10)))), 6) AS p FROM events")
def c9(spark, d):
    return table(spark, d, "events").select("event_id", rounded(N.logistic((F.col("value") - 50) / 10)).alias("p"))


@query("C11_json_capacity", "SELECT event_type, sum((props->>'$.k')::INTEGER)::BIGINT AS total, max((props->>'$.k')::INTEGER)::INTEGER AS most FROM events GROUP BY 1")
def c11(spark, d):
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("most"))


_POINTS = "pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS region, 1.0 + vec_id % 17 AS mw FROM embeddings), ctr AS (SELECT id AS cluster_id, x, y, region FROM pts WHERE id < 40)"


def points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("region"), (F.lit(1.0) + F.col("vec_id") % 17).alias("mw"))


def centres(spark, d):
    return points(spark, d).where("id < 40").select(F.col("id").alias("cluster_id"), "x", "y", "region")


_NEAR = "near AS (SELECT p.id, min({'d2': (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), 'p': c.cluster_id}) AS m FROM pts p, ctr c GROUP BY p.id)"


@query("D1_nearest", f"WITH {_POINTS}, {_NEAR} SELECT id, m.p AS cluster_id, round(sqrt(m.d2), 6) AS distance FROM near")
def d1(spark, d):
    return out(S.nearest(points(spark, d), centres(spark, d).select("cluster_id", "x", "y"), "cluster_id", count=40), ["id"], "cluster_id", "distance")


@query("D2_capacity_by_cluster", f"WITH {_POINTS}, {_NEAR} SELECT m.p AS cluster_id, round(coalesce(sum(mw) FILTER (region % 2 = 0), 0), 6) AS wind, round(coalesce(sum(mw) FILTER (region % 2 = 1), 0), 6) AS solar FROM near JOIN pts USING (id) GROUP BY 1")
def d2(spark, d):
    n = S.nearest(points(spark, d), centres(spark, d).select("cluster_id", "x", "y"), "cluster_id", count=40)
    n = n.withColumn("tech", F.when(F.col("region") % 2 == 0, "wind").otherwise("solar"))
    return out(n.groupBy("cluster_id").pivot("tech", ["wind", "solar"]).agg(F.sum("mw")).na.fill(0.0), ["cluster_id"], "wind", "solar")


@query("D3_region_first", f"WITH {_POINTS}, {_NEAR}, own AS (SELECT p.id, min({{'d2': (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), 'p': c.cluster_id}}) AS m FROM pts p JOIN ctr c ON c.region = p.region GROUP BY p.id) SELECT n.id, coalesce(o.m.p, n.m.p) AS cluster_id FROM near n LEFT JOIN own o USING (id)")
def d3(spark, d):
    p, c = points(spark, d), centres(spark, d)
    own = S.nearest(p, c, "cluster_id", within=["region"], count=40).select("id", F.col("cluster_id").alias("own"))
    every = S.nearest(p, c.select("cluster_id", "x", "y"), "cluster_id", count=40).select("id", F.col("cluster_id").alias("any"))
    return every.join(own, "id", "left").select("id", F.coalesce("own", "any").alias("cluster_id"))


@query("D4_classify", "SELECT s_suppkey, CASE WHEN r_name IN ('EUROPE', 'ASIA') THEN 'east' WHEN s_acctbal < 0 THEN 'debt' ELSE 'west' END AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def d4(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", F.when(F.col("r_name").isin("EUROPE", "ASIA"), "east").when(F.col("s_acctbal") < 0, "debt").otherwise("west").alias("area"))


@query("D6_centroids", f"WITH {_POINTS} SELECT region, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM pts GROUP BY 1")
def d6(spark, d):
    return out(points(spark, d).groupBy("region").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), ["region"], "x", "y")


@query("D7_filter_tokens", "SELECT p_partkey FROM part WHERE list_has_any(regexp_split_to_array(upper(p_type), '[^A-Z0-9]+'), ['STEEL', 'BRASS', 'SMALL', 'A', 'B']) AND p_retailprice > 0")
def d7(spark, d):
    codes = F.array(*[F.lit(c) for c in ("STEEL", "BRASS", "SMALL", "A", "B")])
    return table(spark, d, "part").where(F.arrays_overlap(X.tokens(F.col("p_type")), codes) & (F.col("p_retailprice") > 0)).select("p_partkey")


@query("D8_cluster_weights", f"WITH {_POINTS}, {_NEAR}, g AS (SELECT m.p AS cluster_id, sum(mw) AS weight, count(*) AS n, avg(sqrt(m.d2)) AS mean_distance, max(sqrt(m.d2)) AS max_distance FROM near JOIN pts USING (id) GROUP BY 1) SELECT cluster_id, round(weight, 6) AS weight, n, round(weight / sum(weight) OVER (), 6) AS share, round(mean_distance, 6) AS mean_distance, round(max_distance, 6) AS max_distance FROM g")
def d8(spark, d):
    n = S.nearest(points(spark, d), centres(spark, d).select("cluster_id", "x", "y"), "cluster_id", count=40)
    more = n.groupBy("cluster_id").agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))
    return out(S.shares(n, ["cluster_id"], "mw").join(more, "cluster_id"), ["cluster_id"], "weight", "n", "share", "mean_distance", "max_distance")


@query("D9_region_split", """WITH t AS (SELECT p_brand, p_retailprice AS w, list_distinct(list_filter(regexp_split_to_array(upper(p_type), '[^A-Z0-9]+'), lambda x: x <> '')) AS r FROM part),
e AS (SELECT p_brand, unnest(r) AS region, w / len(r) AS w FROM t), g AS (SELECT p_brand, region, sum(w) AS weight FROM e GROUP BY 1, 2)
SELECT p_brand, region, round(weight, 4) AS weight, round(weight / sum(weight) OVER (PARTITION BY p_brand), 6) AS share FROM g""")
def d9(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part").withColumn("r", F.array_distinct(X.tokens(F.col("p_type"))))
    e = p.select("p_brand", F.explode("r").alias("region"), (F.col("p_retailprice") / F.size("r")).alias("w"))
    g = e.groupBy("p_brand", "region").agg(F.sum("w").alias("weight"))
    return g.select("p_brand", "region", rounded(F.col("weight"), 4).alias("weight"), rounded(F.col("weight") / F.sum("weight").over(Window.partitionBy("p_brand"))).alias("share"))


@query("D15_top_cells", f"""WITH {_POINTS}, c AS (SELECT *, round(x / 0.1)::BIGINT AS cx, round(y / 0.1)::BIGINT AS cy FROM pts),
g AS (SELECT region, cx, cy, sum(mw) AS mw, count(*) AS n, sum(mw * x) / sum(mw) AS x, sum(mw * y) / sum(mw) AS y FROM c GROUP BY 1, 2, 3),
f AS (SELECT *, max((mw >= 20)::INT) OVER (PARTITION BY region) AS a FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mw DESC, n DESC, cx, cy)::INTEGER AS rank FROM f WHERE a = 0 OR mw >= 20)
SELECT region, rank, cx, cy, round(mw, 6) AS mw, n, round(x, 6) AS x, round(y, 6) AS y FROM r WHERE rank <= 3""")
def d15(spark, d):
    t = S.top_cells(points(spark, d), ["region"], 0.1, 3, 20.0)
    return out(t, ["region", "rank", "cx", "cy"], "mw", "n", "x", "y")


_MONTHS = "months AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH))::DATE AS day)"


def months(spark):
    return spark.sql("SELECT explode(sequence(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS day")


@query("D17_active_capacity", f"""WITH {INTERVALS}, {_MONTHS}, k AS (SELECT DISTINCT kind FROM intervals)
SELECT kind, day, round(coalesce((SELECT sum(mw) FROM intervals i WHERE i.kind = k.kind AND i."start"::DATE <= day AND i."end"::DATE > day), 0), 6) AS mw FROM k, months""")
def d17(spark, d):
    return out(P.active(intervals(spark, d), ["kind"], months(spark)), ["kind", "day"], "mw")


@query("D18_capacity_series", f"""WITH {INTERVALS}, {_MONTHS}, a AS (SELECT kind, day, sum(mw) AS mw FROM intervals JOIN months ON "start"::DATE <= day AND "end"::DATE > day GROUP BY 1, 2)
SELECT day, round(coalesce(sum(mw) FILTER (kind = 'A'), 0), 6) AS a, round(coalesce(sum(mw) FILTER (kind = 'N'), 0), 6) AS n, round(coalesce(sum(mw) FILTER (kind = 'R'), 0), 6) AS r, round(coalesce(sum(mw), 0), 6) AS total FROM months LEFT JOIN a USING (day) GROUP BY day""")
def d18(spark, d):
    a = P.active(intervals(spark, d), ["kind"], months(spark))
    w = a.groupBy("day").pivot("kind", ["A", "N", "R"]).agg(F.sum("mw")).na.fill(0.0)
    return w.select("day", *[rounded(F.col(k)).alias(k.lower()) for k in ("A", "N", "R")], rounded(F.col("A") + F.col("N") + F.col("R")).alias("total"))


@query("D19_weather_weights", f"""WITH {INTERVALS}, {_MONTHS}, a AS (SELECT kind, day, sum(mw) AS mw FROM intervals JOIN months ON "start"::DATE <= day AND "end"::DATE > day GROUP BY 1, 2)
SELECT kind, day, round(mw / sum(mw) OVER (PARTITION BY day), 6) AS weight FROM a""")
def d19(spark, d):
    a = P.weights_by(P.active(intervals(spark, d), ["kind"], months(spark)), ["day"])
    return out(a.where("mw > 0"), ["kind", "day"], "weight")


@query("D20_cell_mean", f"""WITH {CLUSTERS}, w AS (SELECT cluster_id, CASE WHEN cluster_id = 3 THEN 0 ELSE 1 + cluster_id END AS w FROM (SELECT DISTINCT cluster_id FROM clusters))
SELECT ts, cluster_id // 4 AS area, round(coalesce(sum(v * w) FILTER (w > 0) / sum(w) FILTER (w > 0 AND v IS NOT NULL), avg(v)), 6) AS v FROM clusters JOIN w USING (cluster_id) GROUP BY 1, 2""")
def d20(spark, d):
    c = clusters(spark, d).withColumn("w", F.when(F.col("cluster_id") == 3, 0.0).otherwise(1.0 + F.col("cluster_id"))).withColumn("area", F.floor(F.col("cluster_id") / 4).cast("int"))
    return out(S.cell_mean(c, ["ts", "area"], "v", "w"), ["ts", "area"], "v")


@query("D21_ensemble", f"WITH {CLUSTERS} SELECT ts, round(avg(v), 6) AS mean, round(stddev_pop(v), 5) AS std FROM clusters GROUP BY ts")
def d21(spark, d):
    return clusters(spark, d).groupBy("ts").agg(rounded(F.avg("v")).alias("mean"), rounded(F.stddev_pop("v"), 5).alias("std"))


@query("D22_layouts", f"""WITH {CLUSTERS}, l AS (SELECT * FROM (VALUES ('pairs', 2), ('halves', 4)) t(layout, k))
SELECT layout, ts, cluster_id // k AS cell, round(avg(v), 6) AS v FROM clusters, l GROUP BY 1, 2, 3""")
def d22(spark, d):
    layouts = spark.createDataFrame([(n, c, c // k) for n, k in (("pairs", 2), ("halves", 4)) for c in range(8)], "layout string, cluster_id int, cell int")
    return out(clusters(spark, d).join(F.broadcast(layouts), "cluster_id").groupBy("layout", "ts", "cell").agg(F.avg("v").alias("v")), ["layout", "ts", "cell"], "v")


_RING = [(-0.1, -0.1), (0.15, -0.05), (0.1, 0.12), (-0.05, 0.2)]
_CROSS = " + ".join(f"CASE WHEN {min(y1, y2)} <= y AND y < {max(y1, y2)} AND x < {x1} + (y - {y1}) * {(x2 - x1) / (y2 - y1)!r} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1], strict=True))


@query("D23_polygon", f"WITH {_POINTS} SELECT id, ({_CROSS}) % 2 = 1 AS inside FROM pts")
def d23(spark, d):
    return points(spark, d).select("id", S.inside_polygon(F.col("x"), F.col("y"), _RING).alias("inside"))


def rings(spark, d):
    """polygon, ring: a kite around every centre."""
    r = F.lit(0.03) + 0.01 * (F.col("cluster_id") % 5)
    x, y = F.col("x"), F.col("y")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return centres(spark, d).select(F.col("cluster_id").alias("polygon"), F.array(corner(x + r, y), corner(x, y + 2 * r), corner(x - r, y), corner(x, y - r)).alias("ring"))


@query("D23_polygon_table", f"""WITH {_POINTS}, k AS (SELECT cluster_id AS polygon, x, y, 0.03::DOUBLE + 0.01::DOUBLE * (cluster_id % 5) AS r FROM ctr),
e AS (SELECT polygon, x + r AS x1, y AS y1, x AS x2, y + 2 * r AS y2 FROM k UNION ALL SELECT polygon, x, y + 2 * r, x - r, y FROM k UNION ALL SELECT polygon, x - r, y, x, y - r FROM k UNION ALL SELECT polygon, x, y - r, x + r, y FROM k)
SELECT id, polygon FROM pts, e GROUP BY id, polygon HAVING count(*) FILTER (least(y1, y2) <= y AND y < greatest(y1, y2) AND x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))) % 2 = 1""")
def d23_table(spark, d):
    return S.points_in_polygons(points(spark, d), rings(spark, d), 0.02)


_LINE = [(-0.3, -0.2), (0.0, 0.1), (0.3, 0.05)]


def _seg(x1, y1, x2, y2) -> str:
    kx, ky = "(cos(radians(y)) * 111.32::DOUBLE)", "110.574::DOUBLE"
    ax, ay, dx, dy = f"(({x1}::DOUBLE - x) * {kx})", f"(({y1}::DOUBLE - y) * {ky})", f"({x2 - x1!r}::DOUBLE * {kx})", f"({y2 - y1!r}::DOUBLE * {ky})"
    t = f"greatest(0, least(1, -({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"


_DIST = "least(" + ", ".join(_seg(*a, *b) for a, b in zip(_LINE, _LINE[1:], strict=False)) + ")"


@query("D24_polyline", f"WITH {_POINTS} SELECT id, round({_DIST}, 5) AS km FROM pts")
def d24(spark, d):
    return points(spark, d).select("id", rounded(S.segment_distance_km(F.col("x"), F.col("y"), _LINE), 5).alias("km"))


@query("D24_line_table", f"""WITH {_POINTS}, s AS (SELECT a.cluster_id % 4 AS line, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ctr a JOIN ctr b ON b.cluster_id = a.cluster_id + 4),
v AS (SELECT id, line, x, y, x1, y1, x2, y2, cos(radians(y)) * 111.32::DOUBLE AS kx, 110.574::DOUBLE AS ky FROM pts, s),
w AS (SELECT *, (x1 - x) * kx AS ax, (y1 - y) * ky AS ay, (x2 - x1) * kx AS dx, (y2 - y1) * ky AS dy FROM v),
t AS (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM w)
SELECT id, line, round(min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))), 5) AS km FROM t WHERE abs(ax + t * dx) <= 0.1 * kx AND abs(ay + t * dy) <= 0.1 * ky GROUP BY 1, 2""")
def d24_table(spark, d):
    a, b = (centres(spark, d).select(F.col("cluster_id").alias(f"c{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i in (1, 2))
    segments = a.join(b, F.col("c2") == F.col("c1") + 4).select((F.col("c1") % 4).alias("line"), "x1", "y1", "x2", "y2")
    return S.lines_distance_km(points(spark, d), segments, 0.1).select("id", "line", rounded(F.col("km"), 5).alias("km"))


@query("D25_exposure", f"""WITH {_POINTS}, k AS (SELECT *, {_DIST} AS km FROM pts), h AS (SELECT region, sum(s * s) AS hhi FROM (SELECT region, id % 9 AS part, sum(mw) / sum(sum(mw)) OVER (PARTITION BY region) AS s FROM pts GROUP BY 1, 2) GROUP BY 1)
SELECT region, round(sum(mw * km) / sum(mw), 5) AS mean_km, round(sum(CASE WHEN km <= 10 THEN mw ELSE 0 END) / sum(mw), 6) AS near_share, round(sum(mw * exp(-km / 100)) / sum(mw), 6) AS score, round(any_value(hhi), 6) AS hhi FROM k JOIN h USING (region) GROUP BY 1""")
def d25(spark, d):
    p = points(spark, d).withColumn("km", S.segment_distance_km(F.col("x"), F.col("y"), _LINE)).withColumn("part", F.col("id") % 9)
    mw, km = F.col("mw"), F.col("km")
    g = p.groupBy("region").agg((F.sum(mw * km) / F.sum(mw)).alias("mean_km"), (F.sum(F.when(km <= 10, mw).otherwise(0.0)) / F.sum(mw)).alias("near_share"), (F.sum(mw * F.exp(-km / 100)) / F.sum(mw)).alias("score"))
    return out(g.join(S.hhi(p, ["region"], "part", "mw"), "region").withColumn("mean_km", F.round("mean_km", 5)), ["region"], "mean_km", "near_share", "score", "hhi")


@query("D26_fleet", f"""WITH {INTERVALS}, {_MONTHS}, a AS (SELECT *, date_diff('day', "start"::DATE, day) AS age FROM intervals JOIN months ON "start"::DATE <= day AND "end"::DATE > day),
h AS (SELECT kind, day, sum(s * s) AS hhi FROM (SELECT kind, day, unit % 10 AS part, sum(mw) / sum(sum(mw)) OVER (PARTITION BY kind, day) AS s FROM a GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT kind, day, round(sum(mw), 6) AS mw, count(*) AS units, round(avg(mw), 6) AS mean_mw, round(max(mw), 6) AS max_mw, round(sum(mw * age) / sum(mw), 6) AS age_days, round(sum(CASE WHEN age <= 30 THEN mw ELSE 0 END) / sum(mw), 6) AS recent_share, count(DISTINCT unit % 10) AS parts, round(any_value(hhi), 6) AS hhi
FROM a JOIN h USING (kind, day) GROUP BY 1, 2""")
def d26(spark, d):
    u = intervals(spark, d).withColumn("part", F.col("unit") % 10)
    f = P.fleet_statistics(u, ["kind"], months(spark), "part", 30)
    return out(f, ["kind", "day"], *f.columns[2:])


@query("D28_null_report", """WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS "view", max(value) FILTER (event_type = 'error') AS error FROM events GROUP BY 1)
SELECT ts, concat_ws(',', CASE WHEN click IS NULL THEN 'click' END, CASE WHEN "view" IS NULL THEN 'view' END, CASE WHEN error IS NULL THEN 'error' END) AS null_columns FROM w WHERE click IS NULL OR "view" IS NULL OR error IS NULL""")
def d28(spark, d):
    names = ["click", "view", "error"]
    w = table(spark, d, "events").groupBy(T.bucket(F.col("ts")).alias("ts")).pivot("event_type", names).agg(F.max("value"))
    missing = F.concat_ws(",", *[F.when(F.col(n).isNull(), F.lit(n)) for n in names])
    return w.select("ts", missing.alias("null_columns")).where("null_columns <> ''")


@query("D29_left_truth", "SELECT o_orderkey, round(sum(l_quantity), 6) AS truth FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > TIMESTAMP '1998-01-01' GROUP BY 1")
def d29(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate > TIMESTAMP_NTZ '1998-01-01 00:00:00'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("truth"))
    return out(table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey", "left"), ["o_orderkey"], "truth")


@query("D30_key_sets", """WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase')
SELECT 'both' AS kind, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_click', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def d30(spark, d):
    e = table(spark, d, "events")
    a, b = (e.where(F.col("event_type") == t).select(F.col("user_id").alias("k")).distinct() for t in ("click", "purchase"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").unionByName(a.subtract(b).select(F.lit("only_click").alias("kind"), "k"))
