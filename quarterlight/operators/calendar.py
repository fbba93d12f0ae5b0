"""Calendar features and holidays from a dimension table (region, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.numeric import cyclic


def calendar_features(df: DataFrame, harmonics: int = 1, zone: str = T.ZONE) -> DataFrame:
    """Local clock and calendar numbers of each ``ts``, with sine and cosine harmonics."""
    here = T.local(F.col("ts"), zone)
    base = df.select(
        "ts", T.mtu(F.col("ts"), zone).alias("mtu"), F.hour(here).alias("hour"), F.weekday(here).alias("dow"), F.month(here).alias("month"),
        F.dayofyear(here).alias("doy"), F.weekofyear(here).alias("week"), (F.hour(here) * 60 + F.minute(here)).alias("minute_of_day"),
    )
    base = base.withColumn("is_weekend", (F.col("dow") >= 5).cast("int"))
    for name, period in (("mtu", 96.0), ("minute_of_day", 1440.0), ("dow", 7.0), ("month", 12.0), ("doy", 365.25), ("week", 53.0)):
        for k in range(1, harmonics + 1):
            s, c = cyclic(F.col(name), period, k)
            base = base.withColumn(f"{name}_sin_{k}", s).withColumn(f"{name}_cos_{k}", c)
    return base


def day_flags(days: DataFrame, holidays: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """holiday, non-workday, workday before and after a holiday, and bridge day, for each (keys, day)."""
    keys = keys or []
    known = holidays.select(*keys, "day").distinct()
    out = days
    for name, shift in (("_h", 0), ("_prev", 1), ("_next", -1)):
        marked = known.select(*keys, F.date_add("day", shift).alias("day"), F.lit(1).alias(name))
        out = out.join(marked, [*keys, "day"], "left")
    out = out.na.fill(0, ["_h", "_prev", "_next"])
    dow = F.weekday("day")
    off = (F.col("_h") == 1) | (dow >= 5)
    before_off = (F.col("_next") == 1) | F.weekday(F.date_add("day", 1)).isin(5, 6)
    after_off = (F.col("_prev") == 1) | F.weekday(F.date_sub(F.col("day"), 1)).isin(5, 6)
    beside = (F.col("_next") == 1) | (F.col("_prev") == 1)
    return out.select(
        *keys, "day", F.col("_h").alias("is_holiday"), off.cast("int").alias("is_non_workday"),
        (~off & (F.col("_next") == 1)).cast("int").alias("is_pre_holiday"), (~off & (F.col("_prev") == 1)).cast("int").alias("is_post_holiday"),
        (~off & before_off & after_off & beside).cast("int").alias("is_bridge_day"),
    )


def regional_shares(days: DataFrame, holidays: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted share of each flag over regions (region, weight)."""
    flags = day_flags(days.crossJoin(F.broadcast(weights.select("region"))), holidays, ["region"])  # regions are a small dimension
    own = flags.join(F.broadcast(weights), "region")
    names = ("is_holiday", "is_non_workday", "is_pre_holiday", "is_post_holiday", "is_bridge_day")
    return own.groupBy("day").agg(*[(F.sum(F.col("weight") * F.col(n)) / F.sum("weight")).alias(f"{n}_share") for n in names])


def regime_features(days: DataFrame, regime_start: str, holidays: DataFrame) -> DataFrame:
    """Regime dummy, weekday one-hot and holiday flag."""
    marked = days.join(holidays.select("day").distinct().withColumn("is_holiday", F.lit(1)), "day", "left").na.fill(0, ["is_holiday"])
    return marked.select("day", (F.col("day") >= F.lit(regime_start).cast("date")).cast("int").alias("post_regime"), "is_holiday", *[(F.weekday("day") == k).cast("int").alias(f"dow_{k}") for k in range(7)])
