"""Engine frames derived from the test tables, and the registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.numeric import rounded, rounded_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = ("WITH " if not sql.lstrip().upper().startswith("WITH") and not sql.lstrip().upper().startswith("SELECT") else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area, ts, v: sum of event values by event type and quarter-hour."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("area"), T.bucket(F.col("ts")).alias("ts")).agg(F.round(F.sum("value"), 4).alias("v"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, v: one actual series."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(T.bucket(F.col("ts")).alias("ts")).agg(F.round(F.sum("value"), 4).alias("v"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, cluster_id, v: mean event value by user cluster and hour."""
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", T.utc(F.col("ts"))).cast("timestamp_ntz")
    return events.groupBy(hour.alias("ts"), (F.col("user_id") % 8).cast("int").alias("cluster_id")).agg(rounded_up(F.avg("value"), 4).alias("v"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, kind, start, end, mw: order date to ship date, from line items."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate > o_orderdate")
    return both.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit"), F.col("l_returnflag").alias("kind"),
        T.utc(F.col("o_orderdate")).alias("start"), T.utc(F.col("l_shipdate")).alias("end"), F.col("l_quantity").alias("mw"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, model, y_pred, y_true: the same quarter-hour 1 and 7 local days before against the actual series."""
    from ..operators.lags import naive

    return naive(series(spark, sf_dir), [1, 7])


# The same frames in the oracle's dialect. January 2024 is one hour ahead of UTC in the local zone.
AREAS = "areas AS (SELECT event_type AS area, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"
SERIES = "series AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(sum(value), 4) AS v FROM events GROUP BY 1)"
CLUSTERS = "clusters AS (SELECT date_trunc('hour', ts) AS ts, (user_id % 8)::INTEGER AS cluster_id, round(avg(value) + 1e-9, 4) AS v FROM events GROUP BY 1, 2)"
INTERVALS = (
    "intervals AS (SELECT l_orderkey * 10 + l_linenumber AS unit, l_returnflag AS kind, o_orderdate AS \"start\", l_shipdate AS \"end\", l_quantity AS mw "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"
)
LOCAL = "(ts + INTERVAL 1 HOUR)"
DAY = f"{LOCAL}::DATE"
MTU = f"(hour({LOCAL}) * 4 + minute({LOCAL}) // 15)::INTEGER"
PANEL = f"""{SERIES},
loc AS (SELECT ts, {DAY} AS day, {MTU} AS mtu, v FROM series),
panel AS (SELECT a.ts, k.model, b.v AS y_pred, a.v AS y_true
  FROM loc a CROSS JOIN (VALUES ('naive_d1', 1), ('naive_d7', 7)) k(model, n)
  JOIN loc b ON b.day = a.day - k.n::INTEGER AND b.mtu = a.mtu)"""
AREA_GRID = f"""{AREAS},
ends AS (SELECT area, min({DAY}) AS a, max({DAY}) AS z FROM areas GROUP BY area),
slots AS (SELECT area, unnest(generate_series(a::TIMESTAMP - INTERVAL 1 HOUR, z::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 75 MINUTE, INTERVAL 15 MINUTE)) AS ts FROM ends),
grid AS (SELECT s.area, s.ts, a.v FROM slots s LEFT JOIN areas a USING (area, ts))"""


def out(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Keys and values, doubles rounded for comparison."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[rounded(F.col(f"`{v}`")).alias(v) if kinds[v] in ("double", "float") else F.col(f"`{v}`") for v in values])
