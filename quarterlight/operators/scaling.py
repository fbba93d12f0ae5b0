"""Scaling of model features by kind, with constants of each delivery day's training window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import feature_kind
from ..functions.numeric import clean
from .linear import by_day, quantile

#: Upper quartile of the standard normal distribution (a fixed value).
Z_75 = 0.6744897501960817


def window_scales(long: DataFrame, keys: list[str], window: int, least: int, lag: int = 1, min_range: float = 20.0, min_share: float = 0.5, min_iqr: float | None = None) -> DataFrame:
    """keys, feature, day, kind, n, lo, hi, center, scale, degenerate of the training rows in [day - window, day - lag].

    ``long`` has keys, feature, day and value, one row a feature and time. center is the median, scale the MAD over the normal's upper quartile, or 1 where that is 0 (0 and 1 without finite values).
    A radiation feature is degenerate if its range, its share of positive rows (missing ones are not) or its IQR is too small. Windows with under
    ``least`` rows have no constants. A day's values travel once, as one array; what is shuffled does not grow with the window.
    """
    own = [*keys, "feature"]
    w = by_day(own, window, lag)
    daily = long.groupBy(*own, "day").agg(F.collect_list(clean(F.col("value"))).alias("_v"), F.count(F.lit(1)).alias("_n"))
    held = daily.select(*own, "day", F.array_sort(F.flatten(F.collect_list("_v").over(w))).alias("_v"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("n")).where(F.col("n") >= least)
    v = F.col("_v")
    held = held.withColumns({"lo": F.get(v, F.lit(0)), "hi": F.get(v, F.size(v) - 1), "center": F.coalesce(quantile(v, 0.5), F.lit(0.0)), "_iqr": quantile(v, 0.75) - quantile(v, 0.25), "_share": F.size(F.filter(v, lambda x: x > 0)) / F.col("n")})
    held = held.withColumn("_mad", quantile(F.array_sort(F.transform("_v", lambda x: F.abs(x - F.col("center")))), 0.5))
    scale = F.when(F.col("_mad") / Z_75 > 1e-12, F.col("_mad") / Z_75).otherwise(F.lit(1.0))
    kind = feature_kind(F.col("feature"))
    flat = (F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)) < min_range) | (F.col("_share") < min_share)
    if min_iqr is not None:
        flat = flat | (F.coalesce("_iqr", F.lit(0.0)) < min_iqr)
    return held.select(*own, "day", kind.alias("kind"), "n", "lo", "hi", "center", scale.alias("scale"), ((kind == "radiation") & flat).alias("degenerate"))


def scale_by_kind(rows: DataFrame, scales: DataFrame, keys: list[str], fold: str = "fold") -> DataFrame:
    """``rows`` (keys, feature, fold, value) with kind and ``scaled``; rows of folds without constants go.

    Prices: asinh of the robust value; wind and load: the robust value; calendar marks: as they are; radiation and others: by the training window's
    extremes, where a constant feature keeps its difference from it, and degenerate or never seen ones are 0. A missing value stays null.
    """
    own = [*keys, "feature"]
    s = scales.withColumnRenamed("day", fold).select(*own, fold, "kind", "lo", "hi", "center", "scale", "degenerate")
    v = clean(F.col("value"))
    robust, span = (v - F.col("center")) / F.col("scale"), F.col("hi") - F.col("lo")
    spread = F.when(F.col("lo").isNull() | F.col("degenerate"), F.lit(0.0)).otherwise((v - F.col("lo")) / F.when(span > 1e-12, span).otherwise(F.lit(1.0)))
    kind = F.col("kind")
    scaled = F.when(kind == "price", F.asinh(robust)).when(kind.isin("wind", "load"), robust).when(kind == "calendar", v).otherwise(spread)
    joined = rows.join(s, [*own, fold]).withColumn("scaled", scaled)
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], "kind", "scaled")
