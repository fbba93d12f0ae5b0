"""Time grid: duplicates, windows, bounded fill, interpolation, day matrices, ramps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T


def keep_last(df: DataFrame, keys: list[str], order: str, *, first: bool = False) -> DataFrame:
    """One row per key: the last (or first) by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc() if first else F.col(order).desc())
    whole = df.select(F.struct("*").alias("row"), F.row_number().over(w).alias("rank")).where("rank = 1")  # a struct, so no column of the caller's clashes
    return whole.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def restrict_days(df: DataFrame, start, end, skip: list | None = None, zone: str = T.ZONE) -> DataFrame:
    """Rows whose local day is in [start, end] and not skipped."""
    day = T.local_day(F.col("ts"), zone)
    kept = df.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return kept.where(~day.isin([F.lit(x).cast("date") for x in skip])) if skip else kept


def dense_grid(df: DataFrame, keys: list[str], zone: str = T.ZONE, minutes: int = 15) -> DataFrame:
    """keys, ts: every slot of every local day from a series' first to its last."""
    day = T.local_day(F.col("ts"), zone)
    ends = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_z"))
    step = F.make_dt_interval(mins=F.lit(minutes))
    return ends.select(*keys, F.explode(F.sequence(T.day_start(F.col("_a"), zone), T.plus(T.next_day_start(F.col("_z"), zone), mins=-minutes), step)).alias("ts"))


def on_grid(df: DataFrame, keys: list[str], value: str = "v", zone: str = T.ZONE) -> DataFrame:
    grid = dense_grid(df, keys, zone)
    return grid.join(df.select(*keys, "ts", value), [*keys, "ts"], "left")


def forward_fill(df: DataFrame, keys: list[str], value: str = "v", limit: int | None = 3) -> Column:
    """Last non-null value at most ``limit`` rows back (None: without limit)."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return F.last(value, ignorenulls=True).over(w)


def expand_hourly(df: DataFrame, keys: list[str], value: str = "v", limit: int = 3, complete_days: bool = True, zone: str = T.ZONE) -> DataFrame:
    """Values on the full 15-minute grid, filled forward ``limit`` slots; days with a missing slot become null."""
    filled = on_grid(df, keys, value, zone)
    filled = filled.withColumn(value, forward_fill(filled, keys, value, limit))
    if complete_days:
        day = Window.partitionBy(*keys, T.local_day(F.col("ts"), zone))
        whole = F.count(value).over(day) == F.count(F.lit(1)).over(day)
        filled = filled.withColumn("_whole", whole).withColumn(value, F.when(F.col("_whole"), F.col(value))).drop("_whole")
    return filled


def interpolate_in_day(df: DataFrame, keys: list[str], slot: str, value: str, limit: int) -> DataFrame:
    """Linear interpolation along the slots of a day, between known values only, for the first ``limit`` cells of a gap."""
    w = Window.partitionBy(*keys).orderBy(slot)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(slot))
    out = df.select(
        "*",
        F.last(value, ignorenulls=True).over(back).alias("_v0"), F.last(known, ignorenulls=True).over(back).alias("_k0"),
        F.first(value, ignorenulls=True).over(ahead).alias("_v1"), F.first(known, ignorenulls=True).over(ahead).alias("_k1"),
    )
    step = F.col(slot) - F.col("_k0")
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * step / (F.col("_k1") - F.col("_k0"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(step <= limit, line)
    return out.withColumn(value, filled).drop("_v0", "_k0", "_v1", "_k1")


def day_matrix(df: DataFrame, keys: list[str], value: str = "v", slots: int = 96, prefix: str = "v", zone: str = T.ZONE) -> DataFrame:
    """One row per local day with a column per slot (mean on collisions)."""
    n = 96 // slots
    long = df.withColumn("local_day", T.local_day(F.col("ts"), zone)).withColumn("_slot", F.floor(T.mtu(F.col("ts"), zone) / n).cast("int"))
    wide = long.groupBy(*keys, "local_day").pivot("_slot", list(range(slots))).agg(F.avg(value))
    return wide.select(*keys, "local_day", *[F.col(str(i)).alias(f"{prefix}_mtu_{i:02d}") for i in range(slots)])


def day_last(df: DataFrame, keys: list[str], value: str = "v", zone: str = T.ZONE) -> DataFrame:
    """Last non-null value of each local day."""
    own = df.where(F.col(value).isNotNull()).groupBy(*keys, T.local_day(F.col("ts"), zone).alias("local_day"))
    return own.agg(F.max_by(value, "ts").alias(value))


def day_summary(df: DataFrame, keys: list[str], value: str = "v", zone: str = T.ZONE) -> DataFrame:
    """Mean, extremes, range, sample deviation, largest hourly ramp, morning and evening figures of each local day."""
    own = df.withColumn("local_day", T.local_day(F.col("ts"), zone)).withColumn("_m", T.mtu(F.col("ts"), zone))
    ramp = F.abs(F.col(value) - F.lag(value, 4).over(Window.partitionBy(*keys, "local_day").orderBy("ts")))
    own = own.withColumn("_ramp", ramp)
    part = lambda lo, hi: F.when(F.col("_m").between(lo, hi), F.col(value))
    return own.groupBy(*keys, "local_day").agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"),
        F.stddev_samp(value).alias("std"), F.max("_ramp").alias("max_ramp"),
        F.avg(part(28, 43)).alias("morning_mean"), F.max(part(28, 43)).alias("morning_max"),
        F.avg(part(60, 75)).alias("evening_mean"), F.max(part(60, 75)).alias("evening_max"),
    )


def ramps(df: DataFrame, keys: list[str], value: str = "v", steps: tuple[int, ...] = (4, 12)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts")
    return df.select("*", *[(F.col(value) - F.lag(value, n).over(w)).alias(f"{value}_ramp_{n}") for n in steps])


def as_of(points: DataFrame, quotes: DataFrame, keys: list[str], value: str, lag_days: int = 0) -> DataFrame:
    """Each point with the last quote at or before it; quotes become known ``lag_days`` later."""
    known = quotes.select(*keys, T.plus(F.col("ts"), days=lag_days).alias("ts"), F.col(value), F.lit(0).alias("_side"))
    asked = points.select(*keys, "ts", F.lit(None).cast(quotes.schema[value].dataType).alias(value), F.lit(1).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(asked).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_side")


def interval_load(intervals: DataFrame, keys: list[str], amount: str, minutes: int = 15) -> DataFrame:
    """Sum of ``amount`` over the intervals [start, end) that cover each slot; slots that none covers are left out.

    An interval is two signed events and a running sum over the events gives the load, so that the intervals
    are read once and the work grows with the intervals and the slots, not with their product.
    """
    first = T.bucket(F.col("start"), minutes)
    first = F.when(first < F.col("start"), T.plus(first, mins=minutes)).otherwise(first)
    own = intervals.withColumn("_a", first).where(F.col("_a") < F.col("end"))
    covered = F.floor((T.seconds(F.col("end")) - 1 - T.seconds(F.col("_a"))) / (60 * minutes)) + 1
    after = F.col("_a") + F.make_dt_interval(mins=(covered * minutes).cast("int"))
    both = F.array(F.struct(F.col("_a").alias("ts"), F.col(amount).alias("x"), F.lit(1).alias("n")), F.struct(after.alias("ts"), (-F.col(amount)).alias("x"), F.lit(-1).alias("n")))
    events = own.select(*keys, F.explode(both).alias("_e")).groupBy(*keys, F.col("_e.ts").alias("ts")).agg(F.sum("_e.x").alias("_x"), F.sum("_e.n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("ts")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # The load is constant from one event to the next; only those stretches become slots.
    held = events.select(*keys, "ts", F.lead("ts").over(order).alias("_next"), F.sum("_n").over(upto).alias("_count"), F.round(F.sum("_x").over(upto), 6).alias(amount))
    step = F.make_dt_interval(mins=F.lit(minutes))
    return held.where(F.col("_count") > 0).select(*keys, F.explode(F.sequence(F.col("ts"), F.col("_next") - step, step)).alias("ts"), amount)


def incomplete_days(df: DataFrame, keys: list[str], value: str = "v", zone: str = T.ZONE) -> DataFrame:
    """Local days with fewer values than slots, as islands of consecutive days."""
    day = T.local_day(F.col("ts"), zone)
    counts = df.groupBy(*keys, day.alias("day")).agg(F.count(value).alias("n"))
    short = counts.where(F.col("n") < T.slots(F.col("day"), zone))
    w = Window.partitionBy(*keys).orderBy("day")
    island = short.withColumn("_island", F.date_sub(F.col("day"), F.row_number().over(w)))
    return island.groupBy(*keys, "_island").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("days")).drop("_island")


def step_mean(df: DataFrame, keys: list[str], value: str, elapsed: str) -> DataFrame:
    """Mean over each step from a running mean since the start: d(f t) / d t, at least 0."""
    w = Window.partitionBy(*keys).orderBy(elapsed)
    ft = F.col(value) * F.col(elapsed)
    d = (ft - F.lag(ft).over(w)) / (F.col(elapsed) - F.lag(elapsed).over(w))
    return df.withColumn(value, F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))))


def align(primary: DataFrame, fallback: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Union of the keys; the primary's values, else the fallback's."""
    other = fallback.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    both = primary.join(other, keys, "full_outer")
    return both.select(*keys, *[F.coalesce(v, f"_{v}").alias(v) for v in values])
