"""Bias correction, residual quantiles and ensembles; only what is known at the cutoff is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linear import by_day, quantile, window_values


def rolling_bias(forecast: DataFrame, keys: list[str], group: str, window: int, least_days: int, shrinkage: float = 1.0) -> DataFrame:
    """forecast (keys, day, group, y_pred, y_true, ...) with ``bias`` and ``y_corrected``.

    The mean past error of the group over the window, the global one where the group has too few days,
    else none. Errors are summed by day; a window adds the sums of its days.
    """

    def past(by: list[str], mean: str, days: str) -> DataFrame:
        e = F.col("y_pred") - F.col("y_true")
        daily = forecast.groupBy(*by, "day").agg(F.sum(e).alias("_e"), F.count(e).alias("_n"))
        w = by_day(by, window)
        return daily.select(*by, "day", F.try_divide(F.sum("_e").over(w), F.sum("_n").over(w)).alias(mean), F.sum((F.col("_n") > 0).cast("int")).over(w).alias(days))

    joined = forecast.join(past([*keys, group], "_g", "_gd"), [*keys, "day", group], "left").join(past(keys, "_a", "_ad"), [*keys, "day"], "left")
    bias = F.coalesce(F.when(F.col("_gd") >= least_days, F.col("_g")), F.when(F.col("_ad") >= least_days, F.col("_a")), F.lit(0.0))
    return joined.withColumn("bias", bias).withColumn("y_corrected", F.col("y_pred") - shrinkage * F.col("bias")).drop("_g", "_gd", "_a", "_ad")


def residual_quantiles(forecast: DataFrame, keys: list[str], group: str, taus: list[float], window: int, least: int, scale: float = 1.0) -> DataFrame:
    """Long (…, tau, q): prediction plus past residual quantiles of the group, else global; at least 0 and monotone in tau.

    A day's residuals travel once, as a sorted array; what is shuffled does not grow with the window.
    """
    r = F.when(F.col("y_true").isNotNull(), F.col("y_true") - F.col("y_pred"))
    points = F.array(*[F.lit(t) for t in taus])
    found = lambda name: F.when(F.size(name) >= least, F.array(*[quantile(F.col(name), t) for t in taus]))
    by = window_values(forecast, [*keys, group], r, window).withColumn("_g", found("values")).drop("values")
    whole = window_values(forecast, keys, r, window).withColumn("_a", found("values")).drop("values")
    joined = forecast.join(by, [*keys, "day", group], "left").join(whole, [*keys, "day"], "left")
    q = F.coalesce("_g", "_a")
    middle = q[taus.index(0.5)]
    long = joined.where(q.isNotNull()).select(*forecast.columns, F.explode(F.arrays_zip(points.alias("tau"), q.alias("r"))).alias("_x"), middle.alias("_m"))
    value = F.greatest(F.col("y_pred") + F.col("_m") + scale * (F.col("_x.r") - F.col("_m")), F.lit(0.0))
    up = Window.partitionBy(*keys, "ts").orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("tau", F.col("_x.tau")).withColumn("_q", value).withColumn("q", F.max("_q").over(up)).drop("_x", "_m", "_q")


def bins(edges: Column, value: Column) -> Column:
    """Right-closed bin of a value: how many distinct edges lie below it."""
    return F.size(F.filter(F.array_distinct(edges), lambda e: e < value))


def ensemble(sources: DataFrame, keys: list[str], weights: dict[str, float] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Mean, median and weighted mean over the models present everywhere, with a check that their truth agrees."""
    n = sources.select("model").distinct().count()
    w = F.lit(1.0)
    for name, x in (weights or {}).items():
        w = F.when(F.col("model") == name, F.lit(x)).otherwise(w)
    g = sources.groupBy(*keys).agg(
        F.count_distinct("model").alias("_n"), F.avg("y_pred").alias("mean"), F.median("y_pred").alias("median"), (F.sum(w * F.col("y_pred")) / F.sum(w)).alias("weighted"),
        F.max("y_true").alias("y_true"), (F.max("y_true") - F.min("y_true") <= tolerance).alias("consistent"),
    )
    return g.where(F.col("_n") == n).drop("_n")


def nowcast_factor(rows: DataFrame, keys: list[str], window: int, least: int, lo: float, hi: float, shrink: float) -> DataFrame:
    """keys, day, factor: trailing ratio of actual to baseline sums, shrunk and clipped; the last one is carried forward."""
    ok = (F.col("baseline") > 0) & F.col("y_true").isNotNull()
    daily = rows.groupBy(*keys, "day").agg(F.sum(F.when(ok, F.col("y_true"))).alias("_a"), F.sum(F.when(ok, F.col("baseline"))).alias("_b"), F.count(F.when(ok, F.lit(1))).alias("_n"))
    past = by_day(keys, window)
    own = daily.select(*keys, "day", *[F.sum(c).over(past).alias(c) for c in ("_a", "_b", "_n")])
    raw = F.when((F.col("_n") >= least) & (F.col("_b") > 0), 1 + shrink * (F.col("_a") / F.col("_b") - 1))
    own = own.withColumn("x", F.when(raw.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), raw))))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return own.select(*keys, "day", F.coalesce(F.last("x", ignorenulls=True).over(w), F.lit(1.0)).alias("factor"))
