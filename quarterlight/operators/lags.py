"""Lag, partial-day and information-cutoff features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T


def naive(df: DataFrame, days: list[int], value: str = "v") -> DataFrame:
    """ts, model, y_pred, y_true: the value of the same local quarter-hour ``k`` local days before.

    Each row offers itself to the days it predicts, so that this is an equi-join on (day, mtu).
    """
    own = df.select("ts", T.local_day(F.col("ts")).alias("day"), T.mtu(F.col("ts")).alias("mtu"), value)
    offer = own.select(F.explode(F.array(*[F.lit(k) for k in days])).alias("k"), "day", "mtu", F.col(value).alias("y_pred"))
    offer = offer.select(F.expr("date_add(day, k)").alias("day"), "mtu", F.concat(F.lit("naive_d"), F.col("k")).alias("model"), "y_pred")
    return own.join(offer, ["day", "mtu"]).select("ts", "model", "y_pred", F.col(value).alias("y_true"))


def lag_by_time(df: DataFrame, keys: list[str], days: list[int], value: str = "v") -> DataFrame:
    """Values exactly n * 24 hours earlier (one row a key and time); gaps give null, not a neighbour.

    Each row offers itself to the times it is a lag of, so that one self join serves all lags.
    """
    offers = df.select(*keys, "ts", F.col(value).alias("_v"), F.explode(F.array(*[F.lit(n) for n in days])).alias("_n"))
    at = F.col("ts") + F.make_dt_interval(days=F.col("_n"))
    past = offers.groupBy(*keys, at.alias("ts")).agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(f"{value}_lag_{n}d") for n in days])
    return df.join(past, [*keys, "ts"], "left")


def window_stats(df: DataFrame, keys: list[str], start: int, end: int, value: str = "v", zone: str = T.ZONE) -> DataFrame:
    """Per local day, statistics of the values between two minutes of the day."""
    here = T.local(F.col("ts"), zone)
    minute = F.hour(here) * 60 + F.minute(here)
    own = df.where(minute.between(start, end) & F.col(value).isNotNull()).groupBy(*keys, T.local_day(F.col("ts"), zone).alias("day"))
    first, last = F.min_by(value, "ts"), F.max_by(value, "ts")
    return own.agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), first.alias("first"), last.alias("last"),
        (F.max(value) - F.min(value)).alias("range"), (last - first).alias("ramp"),
    )


def point_values(df: DataFrame, keys: list[str], minutes: list[int], value: str = "v", zone: str = T.ZONE) -> DataFrame:
    """Per local day, the value at fixed clock times."""
    here = T.local(F.col("ts"), zone)
    minute = F.hour(here) * 60 + F.minute(here)
    own = df.where(minute.isin(minutes)).withColumn("_m", minute)
    return own.groupBy(*keys, T.local_day(F.col("ts"), zone).alias("day")).agg(*[F.max(F.when(F.col("_m") == m, F.col(value))).alias(f"at_{m // 60:02d}{m % 60:02d}") for m in minutes])


def partial_day(df: DataFrame, keys: list[str], starts: list[int], end: int, back: int, value: str = "v", zone: str = T.ZONE) -> DataFrame:
    """For delivery day D: the mean of D-1 between each start and ``end``, and its difference to ``back`` days before that.

    One aggregate serves all starts, and one self join all differences.
    """
    here = T.local(F.col("ts"), zone)
    minute = F.hour(here) * 60 + F.minute(here)
    own = df.select(*keys, T.local_day(F.col("ts"), zone).alias("day"), minute.alias("_minute"), F.col(value).alias("_v")).where(F.col("_minute").between(min(starts), end) & F.col("_v").isNotNull())
    tags = {s: f"{s // 60:02d}" for s in starts}
    stats = own.groupBy(*keys, "day").agg(*[F.avg(F.when(F.col("_minute") >= s, F.col("_v"))).alias(f"mean_{t}") for s, t in tags.items()])
    before = stats.select(*keys, F.date_add("day", back).alias("day"), *[F.col(f"mean_{t}").alias(f"_b_{t}") for t in tags.values()])
    both = stats.join(before, [*keys, "day"], "left").withColumn("day", F.date_add("day", 1))
    return both.select(*keys, "day", *[x for t in tags.values() for x in (F.col(f"mean_{t}"), (F.col(f"mean_{t}") - F.col(f"_b_{t}")).alias(f"diff_{t}"))])


def cutoff(day: Column, lag_days: int = 1, hour: int | None = None, minute: int = 0, before_day: bool = False, zone: str = T.ZONE) -> Column:
    """Latest usable local timestamp for delivery day D, as UTC: D - lag at hour:minute.

    Without an hour: 23:45 of that day, or 15 minutes before it begins (``before_day``).
    """
    base = F.date_sub(day, lag_days).cast("timestamp_ntz")
    if hour is not None:
        at = T.plus(base, hours=hour, mins=minute)
    else:
        at = T.plus(base, mins=-15) if before_day else T.plus(base, hours=23, mins=45)
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), at)


def history_means(errors: DataFrame, days: DataFrame, window: int, group: str, least: int, value: str = "e", lag_days: int = 1, hour: int = 10) -> DataFrame:
    """day, group, mean error over (cutoff - window, cutoff]; null below ``least`` observations.

    The range join is an equi-join: each error row is offered to the at most window + 2 days it can serve.
    """
    own = errors.where(F.col(value).isNotNull()).withColumn("_d", T.local_day(F.col("ts")))
    served = own.withColumn("day", F.explode(F.sequence(F.date_add("_d", lag_days - 1), F.expr(f"date_add(_d, {lag_days + window + 1})"))))
    served = served.join(days.select("day"), "day", "left_semi")
    end = cutoff(F.col("day"), lag_days, hour)
    inside = (F.col("ts") <= end) & (F.col("ts") > T.plus(end, days=-window))
    sums = served.where(inside).groupBy("day", group).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return sums.select("day", group, F.when(F.col("n") >= least, F.col("mean")).alias("mean"), "n")


def shifts(df: DataFrame, keys: list[str], value: str = "v", lags: tuple = (1,), leads: tuple = (1,), diffs: tuple = (1,)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts")
    return df.select(
        "*", *[F.lag(value, n).over(w).alias(f"{value}_lag_{n}") for n in lags], *[F.lead(value, n).over(w).alias(f"{value}_lead_{n}") for n in leads],
        *[(F.col(value) - F.lag(value, n).over(w)).alias(f"{value}_diff_{n}") for n in diffs],
    )


def centred_window(df: DataFrame, keys: list[str], half: int, value: str = "v") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-half, half)
    return df.select("*", F.avg(value).over(w).alias("mean"), F.stddev_samp(value).over(w).alias("std"), F.min(value).over(w).alias("min"), F.max(value).over(w).alias("max"))
