"""Scans with declared columns, and sinks in a folder that all executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as T


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a session on one machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="quarterlight-")).rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_base(spark)}/quarterlight-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """The rows by a reliable checkpoint in the shared folder: computed once, and safe when an executor is lost."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, or an error that names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV, text-separated or Parquet by suffix."""
    name = path.rsplit("/", 1)[-1]
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else "parquet"
    if kind in ("csv", "txt"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    raise ValueError(f"unknown format: {kind}")


def positive_weights(df: DataFrame, key: str, weight: str) -> DataFrame:
    """key, weight: sums of finite weights, positive ones only."""
    ok = F.col(key).isNotNull() & F.col(weight).isNotNull() & (F.abs(F.col(weight)) < F.lit(float("inf"))) & ~F.isnan(weight)
    return df.where(ok).groupBy(key).agg(F.sum(weight).alias("weight")).where("weight > 0")


def parse_instant(text: Column, zone: str) -> Column:
    """UTC instant of a timestamp text that may carry an offset; without one it is local."""
    offset = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 1)
    minutes = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$", 2)
    plain = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "").cast("timestamp_ntz")
    shift = F.when(offset == "", F.lit(0)).otherwise(offset.try_cast("int") * 60 + F.when(offset.startswith("-"), -minutes.try_cast("int")).otherwise(minutes.try_cast("int")))
    given = plain - F.make_dt_interval(mins=F.coalesce(shift, F.lit(0)))
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), given).otherwise(F.convert_timezone(F.lit(zone), F.lit("UTC"), plain))


def upsert(cached: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the keys; a fresh row replaces the cached one."""
    return fresh.unionByName(cached.join(fresh.select(*keys).distinct(), keys, "left_anti"))


def missing_days(cached: DataFrame, expected: DataFrame, day: str = "day") -> DataFrame:
    return expected.join(cached.select(day).distinct(), day, "left_anti")


def request(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of the ``wanted`` keys from the cache at ``path``, with ``hit``: whether the cache had the key before.

    Keys that are missing are fetched, all in one call, and stored as partitions of their own.
    """
    have = existing(spark, path)
    asked = wanted.select(*keys).distinct()
    asked = settle(asked.withColumn("hit", F.lit(False)) if have is None else asked.join(have.select(*keys).distinct().withColumn("hit", F.lit(True)), keys, "left").na.fill(False, ["hit"]))
    missing = asked.where("NOT hit").select(*keys)
    if not missing.isEmpty():
        write_partitions(fetch(missing), path, *keys)
    return spark.read.parquet(path).join(F.broadcast(asked), keys) if asked.count() <= 10_000 else spark.read.parquet(path).join(asked, keys)


def reuse_or_build(spark: SparkSession, path: str, columns: list[str], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The stored table if it has every column, else the one built and stored in its place; and whether it was reused."""
    stored = existing(spark, path)
    if stored is not None and set(columns) <= set(stored.columns):
        return stored.select(*columns), True
    build().select(*columns).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False


def allow_list(spark: SparkSession, path: str, target: str, aliases: dict[str, str] | None = None) -> list[str]:
    """Feature names of a target from a CSV file (target, feature); blank lines and # comments are skipped, order is kept.

    The file is a hand-written list of column names, so it is read whole.
    """
    lines = [r["value"].split("#")[0].strip() for r in spark.read.text(path, wholetext=False).collect()]
    pairs = [tuple(x.strip() for x in line.split(",", 1)) for line in lines if "," in line]
    return list(dict.fromkeys(f for t, f in pairs if t in (target, (aliases or {}).get(target, target), "*")))


def issue_folders(landed: DataFrame, run: int, start: str, skip: tuple[str, ...], states: list[str], fluxes: list[str], zone: str = T.ZONE) -> DataFrame:
    """issue_day, valid, cluster_id, one column a variable, hourly: the delivery day of each issue day from one run's folders.

    ``landed`` (variable, issue_day, run, stamp, cluster_id, v) is partitioned by issue day and run, so other
    folders are not read. A flux is stamped with the end of its quarter-hour and moves to its begin; states are
    hourly. Variables meet by time, whichever of them is there.
    """
    days = [F.lit(x).cast("date") for x in skip]
    chosen = landed.where((F.col("run") == run) & (F.col("issue_day") >= F.lit(start).cast("date")) & ~F.col("issue_day").isin(days))
    chosen = chosen.withColumn("valid", F.when(F.col("variable").isin(fluxes), T.plus(F.col("stamp"), mins=-15)).otherwise(F.col("stamp")))
    day = F.date_add("issue_day", 1)
    inside = chosen.where((F.col("valid") >= T.day_start(day, zone)) & (F.col("valid") < T.next_day_start(day, zone)))
    wide = inside.groupBy("issue_day", "valid", "cluster_id").pivot("variable", [*states, *fluxes]).agg(F.max("v"))
    return wide.withColumn("hourly", F.minute("valid") == 0)


def write_bundle(forecast: DataFrame, runtime: DataFrame, metrics: DataFrame, config: dict, path: str) -> dict[str, DataFrame]:
    """An experiment's outputs in one folder, read back by name: forecast by month, runtime and metrics as CSV, configuration as one JSON row."""
    spark = forecast.sparkSession
    found = {"forecast": write_partitions(forecast, f"{path}/forecast", "month")}
    for name, table in (("runtime", runtime), ("metrics", metrics)):
        table.coalesce(1).write.csv(f"{path}/{name}", header=True)  # a row a day, or a model and month
        found[name] = spark.read.schema(table.schema).csv(f"{path}/{name}", header=True)
    spark.createDataFrame([(json.dumps(config),)], "value string").write.text(f"{path}/config")
    found["config"] = spark.read.json(f"{path}/config")
    return found


def write_partitions(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write partitioned Parquet and read it back; a second write replaces only the partitions it holds."""
    spark = df.sparkSession
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return spark.read.parquet(path)
