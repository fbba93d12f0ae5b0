"""Weather aggregation in long form: regional moments, spreads, quantiles, regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.numeric import logistic


def mean0(value: Column, weight: Column) -> Column:
    """Weighted mean; 0 where the weights sum to 0."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(weight * value) / total).otherwise(F.lit(0.0))


def std0(value: Column, weight: Column) -> Column:
    m, q = mean0(value, weight), mean0(value * value, weight)
    return F.sqrt(F.greatest(q - m * m, F.lit(0.0)))


def direction(u: Column, v: Column, weight: Column) -> tuple[Column, Column]:
    """Weighted mean unit vector."""
    speed = F.sqrt(u * u + v * v)
    unit = lambda x: F.when(speed > 0, x / speed).otherwise(F.lit(0.0))
    return mean0(unit(u), weight), mean0(unit(v), weight)


def available_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over the values that are there; null without any."""
    return F.sum(weight * value) / F.sum(F.when(value.isNotNull(), weight))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.stddev_samp(v).alias("std"),
        F.percentile(v, F.lit(0.1)).alias("p10"), F.percentile(v, F.lit(0.9)).alias("p90"),
    )


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, taus: list[float], tie: str) -> DataFrame:
    """First value, in order, whose cumulative weight reaches tau times the total."""
    own = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    w = Window.partitionBy(*keys)
    ranked = own.withColumn("_cum", F.sum(weight).over(w.orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(w))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_cum") >= t * F.col("_all") - 1e-12, F.col(value))).alias(f"q{int(round(t * 100)):02d}") for t in taus])


def daily_difference(df: DataFrame, keys: list[str], value: str, lag: int) -> DataFrame:
    """Daily mean, extremes and range, and the mean's difference to ``lag`` days before."""
    day = T.local_day(F.col("ts"))
    g = df.groupBy(*keys, day.alias("day")).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"))
    before = g.select(*keys, F.date_add("day", lag).alias("day"), F.col("mean").alias("_m"))
    return g.join(before, [*keys, "day"], "left").withColumn(f"diff_{lag}d", F.col("mean") - F.col("_m")).drop("_m")


def inertia(df: DataFrame, keys: list[str], value: str, hours: int) -> DataFrame:
    """Rolling statistics over the last ``hours`` by time; null below max(1, 2 * hours) values."""
    own = df.withColumn("_s", T.seconds(F.col("ts")))
    w = Window.partitionBy(*keys).orderBy("_s").rangeBetween(-(hours * 3600 - 1), 0)
    enough = F.count(value).over(w) >= max(1, 2 * hours)
    stat = lambda c: F.when(enough, c)
    out = own.withColumn("mean", stat(F.avg(value).over(w))).withColumn("min", stat(F.min(value).over(w))).withColumn("max", stat(F.max(value).over(w)))
    return out.withColumn("range", F.col("max") - F.col("min")).withColumn("delta", F.col(value) - F.col("mean")).drop("_s")


def exceedance(df: DataFrame, keys: list[str], thresholds: list[float], floor: float) -> DataFrame:
    """Per key, soft exceedance of each threshold from mean and std columns: average, maximum and share above."""
    z = lambda t: (F.col("mean") - t) / F.greatest(F.col("std"), F.lit(floor))
    aggs = []
    for t in thresholds:
        tag = f"{t:g}".replace(".", "p")
        aggs += [F.avg(logistic(z(t))).alias(f"risk_{tag}"), F.max(logistic(z(t))).alias(f"max_risk_{tag}"), F.avg((F.col("mean") >= t).cast("int")).alias(f"share_{tag}"), F.max(F.greatest(F.col("mean") - t, F.lit(0.0))).alias(f"excess_{tag}")]
    return df.groupBy(*keys).agg(*aggs)


def regional_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum, extremes, spread, deviation and the sum of the two largest."""
    v = F.col(value)
    two = F.aggregate(F.slice(F.sort_array(F.collect_list(v), asc=False), 1, 2), F.lit(0.0), lambda a, x: a + x)
    return df.groupBy(*keys).agg(F.sum(v).alias("total"), F.max(v).alias("max"), F.min(v).alias("min"), (F.max(v) - F.min(v)).alias("spread"), F.stddev_samp(v).alias("std"), two.alias("top2"))
