"""Capacity in service over time, from units valid in [start, end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days that can be asked for at once.
DAYS = 100_000


def calendar(days: DataFrame) -> DataFrame:
    """One row with the sorted array ``_days`` of the asked days. A calendar is short: DAYS at most, or an error."""
    found = days.agg(F.array_sort(F.collect_set(F.col("day").cast("date"))).alias("_days"))
    return found.select(F.when(F.size("_days") <= DAYS, F.col("_days")).otherwise(F.raise_error(F.lit(f"more than {DAYS} days asked"))).alias("_days"))


def active(units: DataFrame, keys: list[str], days: DataFrame, mw: str = "mw") -> DataFrame:
    """keys, day, mw: capacity in service at each day of ``days``, never negative, for every key of ``units``.

    A unit is two signed events, read once; a running sum per key holds from one event to the
    next and is given out to the asked days in between.
    """
    both = F.array(F.struct(F.col("start").cast("date").alias("day"), F.col(mw).alias("x")), F.struct(F.col("end").cast("date").alias("day"), (-F.col(mw)).alias("x")))
    events = units.select(*keys, F.explode(both).alias("_e")).where("_e.day IS NOT NULL").groupBy(*keys, F.col("_e.day").alias("_from")).agg(F.sum("_e.x").alias("_x"))
    order = Window.partitionBy(*keys).orderBy("_from")
    held = events.select(
        *keys, "_from", F.lead("_from").over(order).alias("_to"), (F.row_number().over(order) == 1).alias("_first"),
        F.greatest(F.round(F.sum("_x").over(order.rowsBetween(Window.unboundedPreceding, 0)), 6), F.lit(0.0)).alias("mw"),
    )
    mine = lambda d: (F.col("_first") | (d >= F.col("_from"))) & (F.col("_to").isNull() | (d < F.col("_to")))  # noqa: E731  the first stretch also serves the days before it
    out = held.crossJoin(F.broadcast(calendar(days))).withColumn("day", F.explode(F.filter("_days", mine)))
    return out.select(*keys, "day", F.when(F.col("day") < F.col("_from"), F.lit(0.0)).otherwise(F.col("mw")).alias("mw"))


def weights_by(active_rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of each row in its group's active capacity; null where nothing is active."""
    total = F.sum("mw").over(Window.partitionBy(*by))
    return active_rows.withColumn("weight", F.when(total > 0, F.col("mw") / total))


def fleet_statistics(units: DataFrame, keys: list[str], days: DataFrame, part: str, recent_days: int = 365) -> DataFrame:
    """Per key and day: MW, units, mean and largest size, weighted age, share built recently, parts and concentration by part.

    Units are read once and go to the asked days of their own life; sums by part, then by key.
    """
    asked = days.select(F.col("day").cast("date").alias("day")).distinct()
    span = calendar(asked).select(F.array_min("_days").alias("_lo"), F.array_max("_days").alias("_hi"))  # one row
    begin, last = F.greatest(F.col("start").cast("date"), "_lo"), F.least(F.coalesce(F.date_sub(F.col("end").cast("date"), 1), "_hi"), "_hi")
    own = units.crossJoin(F.broadcast(span)).withColumn("_lo", begin).withColumn("_hi", last).where("_lo <= _hi")
    # Each unit goes to the months of its life, and by an equi-join to the days asked in them.
    own = own.withColumn("_month", F.explode(F.sequence(F.trunc("_lo", "month"), F.trunc("_hi", "month"), F.expr("INTERVAL 1 MONTH"))))
    alive = own.join(F.broadcast(asked.withColumn("_month", F.trunc("day", "month"))), "_month").where("day BETWEEN _lo AND _hi")
    age = F.datediff("day", F.col("start").cast("date"))
    own = alive.groupBy(*keys, "day", F.col(part).alias("_part")).agg(
        F.sum("mw").alias("_w"), F.count(F.lit(1)).alias("_n"), F.max("mw").alias("_max"), F.sum(F.col("mw") * age).alias("_age"), F.sum(F.when(age <= recent_days, F.col("mw")).otherwise(0.0)).alias("_new"),
    )
    total = F.sum("_w")
    return own.groupBy(*keys, "day").agg(
        total.alias("mw"), F.sum("_n").alias("units"), (total / F.sum("_n")).alias("mean_mw"), F.max("_max").alias("max_mw"),
        (F.sum("_age") / total).alias("age_days"), (F.sum("_new") / total).alias("recent_share"), F.count("_part").alias("parts"), (F.sum(F.col("_w") * F.col("_w")) / (total * total)).alias("hhi"),
    )
