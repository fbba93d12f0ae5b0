"""Groups of a forecast's rows by time and by quantile bins: corrections from history, residual diagnostics, importance of feature groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.numeric import clean, rounded_up
from .linear import by_day, quantile

#: What a correction may be grouped by. Bins are those of the prediction by quantile edges of history.
GROUPINGS = ["none", "global", "hour", "mtu", "daytype_hour", "daytype_mtu", "prediction_bin", "hour_prediction_bin", "mtu_prediction_bin", "daytype_prediction_bin"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def range_quantiles(rows: DataFrame, keys: list[str], value: Column, parts: int, splits: int = 128) -> DataFrame:
    """keys, n, points: the exact linear quantiles 0, 1/parts, ..., 1 of each key's finite values.

    Equal values are counted first. Approximate cuts part a key's distinct values into ranges, whose counts tell which few ranges
    hold the wanted ranks; only these are sorted, each by itself. So no task sorts a whole key. Null keys are left out.
    """
    own = rows.select(*keys, clean(value).alias("_v")).where(F.col("_v").isNotNull())
    counts = own.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*[F.lit(i / splits) for i in range(1, splits)]), 10 * splits).alias("_c"))
    ranged = counts.join(cuts, keys).withColumn("_b", F.size(F.filter("_c", lambda c: c < F.col("_v")))).drop("_c")
    sums = ranged.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))  # at most ``splits`` rows a key
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_s", before).withColumn("n", F.sum("_m").over(Window.partitionBy(*keys)))
    low = lambda i: F.floor((F.col("n") - 1) * i / parts).cast("long")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(low(i), F.least(low(i) + 1, F.col("n") - 1)) for i in range(parts + 1)])))
    held = sums.withColumn("_w", F.filter(ranks, lambda r: (r >= F.col("_s")) & (r < F.col("_s") + F.col("_m")))).where(F.size("_w") > 0)
    upto = F.col("_s") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.join(held, [*keys, "_b"]).withColumn("_u", upto)
    found = found.withColumn("_r", F.explode(F.filter("_w", lambda r: (r >= F.col("_u") - F.col("_n")) & (r < F.col("_u")))))
    at = found.groupBy(*keys).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_a"))

    def point(i: int) -> Column:
        a, b = F.col("_a")[low(i)], F.col("_a")[F.least(low(i) + 1, F.col("n") - 1)]
        return a + (b - a) * (((F.col("n") - 1) * i) % parts / parts)

    return at.select(*keys, "n", F.array(*[point(i) for i in range(parts + 1)]).alias("points"))


def bin_edges(points: Column, n: Column, n_bins: int, digits: int = 6) -> Column:
    """Inner edges of right-closed bins from quantiles; null (one bin) for fewer values than bins or than two distinct bins.

    Edges are rounded, so that the last bit of an interpolated one does not decide about values that equal it.
    """
    edges = F.array_distinct(F.transform(points, lambda p: rounded_up(p, digits)))
    return F.when((n >= max(2, n_bins)) & (F.size(edges) >= 3), F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0))))


def bin_label(edges: Column, value: Column) -> Column:
    """Number of the value's bin as text, ``missing`` for a null value, ``all`` without edges."""
    number = F.size(F.filter(edges, lambda e: e < value)).cast("string")
    return F.when(edges.isNull(), "all").when(clean(value).isNull(), "missing").otherwise(number)


def group_key(grouping: str, hour: Column, mtu: Column, weekend: Column, label: Column) -> Column:
    """The group of a row under a grouping; ``label`` is its prediction bin."""
    kind, h, m = F.when(weekend, "weekend").otherwise("weekday"), hour.cast("string"), mtu.cast("string")
    by = {
        "none": F.lit("none"), "global": F.lit("global"), "hour": h, "mtu": m, "daytype_hour": F.concat(kind, F.lit("_h"), h), "daytype_mtu": F.concat(kind, F.lit("_m"), m),
        "prediction_bin": label, "hour_prediction_bin": F.concat(h, F.lit("_b"), label), "mtu_prediction_bin": F.concat(m, F.lit("_b"), label),
        "daytype_prediction_bin": F.concat(kind, F.lit("_b"), label),
    }
    if grouping not in by:
        raise ValueError(f"no such grouping: {grouping}")
    return by[grouping]


def _clock(rows: DataFrame) -> DataFrame:
    here = T.local(F.col("ts"))
    return rows.withColumns({"_hour": F.hour(here), "_mtu": T.mtu(F.col("ts")), "_weekend": F.weekday(here) >= 5})


def _exploded(groupings: list[str], label: Column, of: Column | None = None) -> Column:
    part = (lambda c: of[c]) if of is not None else F.col
    return F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), group_key(g, part("_hour"), part("_mtu"), part("_weekend"), label).alias("group")) for g in groupings]))


def corrections(forecast: DataFrame, keys: list[str], groupings: list[str], window: int, least: int, n_bins: int = 5, shrinkage: float = 1.0) -> DataFrame:
    """forecast (keys, ts, day, y_pred, y_true, ...) once for each grouping, with grouping, group, correction and y_corrected (at least 0).

    The correction is the mean past error of the row's group in the window of days before; that of all rows where the
    group has under ``least`` of them; 0 if the window has under ``least`` in all, or under ``none``. Bins are those of the day's own window: its
    history is binned by the day's edges, not by those of its own days. Groupings by time are sums of daily sums. Those by bins read the window's
    rows where the series stands, one array a day, so what is shuffled does not grow with the window. Rows without a truth or a prediction are no history.
    """
    rows = _clock(forecast).withColumn("_e", clean(F.col("y_pred") - F.col("y_true")))
    pair = F.when(F.col("_e").isNotNull(), F.struct("y_pred", "_e", "_hour", "_mtu", "_weekend"))
    past = by_day(keys, window)
    daily = rows.groupBy(*keys, "day").agg(F.sum("_e").alias("_s"), F.count("_e").alias("_c"), F.collect_list(pair).alias("_v"))
    held = daily.select(*keys, "day", F.sum("_s").over(past).alias("_s"), F.coalesce(F.sum("_c").over(past), F.lit(0)).alias("_c"), F.flatten(F.collect_list("_v").over(past)).alias("_v"))
    held = held.withColumn("_p", F.array_sort(F.transform("_v", lambda v: v["y_pred"])))
    points = F.array(*[quantile(F.col("_p"), i / max(2, n_bins)) for i in range(max(2, n_bins) + 1)])
    held = held.withColumn("_edges", bin_edges(points, F.col("_c"), n_bins))
    binned = [g for g in groupings if g.endswith("prediction_bin")]
    timed = [g for g in groupings if g not in binned and g != "none"]
    stats = None
    if binned:
        long = held.select(*keys, "day", "_edges", F.explode("_v").alias("_x"))
        long = long.select(*keys, "day", F.col("_x._e").alias("_e"), _exploded(binned, bin_label(F.col("_edges"), F.col("_x.y_pred")), F.col("_x")).alias("_g"))
        stats = long.groupBy(*keys, "day", "_g.grouping", "_g.group").agg(F.avg("_e").alias("_mean"), F.count("_e").alias("_n"))
    if timed:
        by = [*keys, "grouping", "group"]
        long = rows.select(*keys, "day", "_e", _exploded(timed, F.lit("")).alias("_g"))
        sums = long.groupBy(*keys, "day", "_g.grouping", "_g.group").agg(F.sum("_e").alias("_s"), F.count("_e").alias("_n"))
        own = by_day(by, window)
        timed_stats = sums.select(*keys, "day", "grouping", "group", F.try_divide(F.sum("_s").over(own), F.sum("_n").over(own)).alias("_mean"), F.sum("_n").over(own).alias("_n"))
        stats = timed_stats if stats is None else stats.unionByName(timed_stats)
    each = rows.join(held.select(*keys, "day", "_s", "_c", "_edges"), [*keys, "day"]).withColumn("_g", _exploded(groupings, bin_label(F.col("_edges"), F.col("y_pred"))))
    each = each.withColumns({"grouping": F.col("_g.grouping"), "group": F.col("_g.group")})
    if stats is None:
        each = each.withColumn("correction", F.lit(0.0))
    else:
        each = each.join(stats.withColumnsRenamed({"_n": "_k"}), [*keys, "day", "grouping", "group"], "left")
        known = F.coalesce(F.when(F.col("_k") >= least, F.col("_mean")), F.col("_s") / F.col("_c"))
        each = each.withColumn("correction", F.when((F.col("_c") >= least) & (F.col("grouping") != "none"), known).otherwise(0.0))
    y = F.col("y_pred") - shrinkage * F.col("correction")
    return each.select(*[F.col(f"`{c}`") for c in forecast.columns], "grouping", "group", "correction", F.when(y.isNotNull(), F.greatest(y, F.lit(0.0))).alias("y_corrected"))


def ramps(forecast: DataFrame, keys: list[str], hours: list[int]) -> DataFrame:
    """``forecast`` with ramp_1h, ...: the absolute change of y_true against so many hours before, by time; null where either is missing.

    A value goes to the times that it serves, and each time keeps its own by one aggregate; no series is sorted.
    """
    serves = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), T.plus(F.col("ts"), hours=h).alias("at")) for h in hours])).alias("_x")
    old = forecast.where(clean(F.col("y_true")).isNotNull()).select(*keys, "y_true", serves)
    old = old.groupBy(*keys, F.col("_x.at").alias("ts")).agg(*[F.max(F.when(F.col("_x.h") == h, F.col("y_true"))).alias(f"_o{h}") for h in hours])
    both = forecast.join(old, [*keys, "ts"], "left")
    return both.withColumns({f"ramp_{h}h": F.abs(F.col("y_true") - F.col(f"_o{h}")) for h in hours}).drop(*[f"_o{h}" for h in hours])


def residual_diagnostics(forecast: DataFrame, keys: list[str], n_bins: int = 5, hours: tuple[int, ...] = (1, 3), capacity: dict[str, float] | None = None) -> DataFrame:
    """keys, dimension, level, mae, rmse, bias, nrmse_pct, n_obs by time (hour, mtu, month, weekday, daytype), level and ramp bins.

    ``forecast`` (keys, ts, y_pred, y_true) is read a few times: give it written. Bins are by exact quantiles over a key's rows. A row without a
    prediction or a truth counts to its levels, with no error. ``capacity`` gives megawatts by the first key's values; without one nrmse_pct is null.
    """
    rows = ramps(forecast, keys, list(hours))
    here = T.local(F.col("ts"))
    binned = {"actual_bin": "y_true", "prediction_bin": "y_pred", **{f"actual_ramp_{h}h_bin": f"ramp_{h}h" for h in hours}}
    measured = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("v")) for name, c in binned.items()])).alias("_m"))
    points = range_quantiles(measured.select(*keys, F.col("_m.name").alias("name"), F.col("_m.v").alias("v")), [*keys, "name"], F.col("v"), max(2, n_bins))
    edges = points.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", bin_edges(F.col("points"), F.col("n"), n_bins).alias("e")))).alias("_edges"))
    names = F.array(*[F.lit(x) for x in WEEKDAYS])
    levels = {
        "hour": F.hour(here).cast("string"), "mtu": T.mtu(F.col("ts")).cast("string"), "month": F.date_format(here, "yyyy-MM"),
        "weekday": F.get(names, F.weekday(here)), "daytype": F.when(F.weekday(here) >= 5, "weekend").otherwise("weekday"),
        **{name: bin_label(F.col("_edges")[name], F.col(c)) for name, c in binned.items()},
    }
    long = rows.join(edges, keys, "left").select(
        *keys, clean(F.col("y_pred") - F.col("y_true")).alias("_e"), F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("level")) for k, v in levels.items()])).alias("_l")
    )
    e = F.col("_e")
    m = long.groupBy(*keys, "_l.dimension", "_l.level").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count(e).alias("n_obs"))
    top = F.lit(None).cast("double")
    for name, mw in (capacity or {}).items():
        top = F.when(F.col(keys[0]) == name, F.lit(float(mw))).otherwise(top)
    return m.withColumn("nrmse_pct", F.when(top > 0, 100 * F.col("rmse") / top))


def group_importance(long: DataFrame, sample: list[str], group: str, by: list[str] | None = None) -> DataFrame:
    """by, group, n, mean_abs, median_abs, share: from contributions (by, sample, group, contribution), summed by sample and group first.

    A group's share is its mean absolute sum over that of all groups. Rows without a group are left out.
    """
    by = by or []
    sums = long.where(F.col(group).isNotNull()).groupBy(*by, *sample, group).agg(F.abs(F.sum("contribution")).alias("_c"))
    mean = sums.groupBy(*by, group).agg(F.count("_c").alias("n"), F.avg("_c").alias("mean_abs"))
    middle = range_quantiles(sums, [*by, group], F.col("_c"), 2).select(*by, group, F.col("points")[1].alias("median_abs"))
    total = F.sum("mean_abs").over(Window.partitionBy(*(by or [F.lit(1)])))  # a row a group
    return mean.join(middle, [*by, group], "left").withColumn("share", F.try_divide(F.col("mean_abs"), total))
