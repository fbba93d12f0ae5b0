"""Ridge models of rolling windows from daily sufficient statistics.

A day of a series gives one row: the sums of products of (1, features, marks of missing
features, target). A window's sums are those of its days, so no training row is copied into
the windows it serves, and what is shuffled is one row a day, whatever the window. Missing features take the
window's median; since that is a linear map of features and marks, it is applied to the sums. Medians
come from the days' sorted values (``window_values``). A model is one row of coefficients;
predictions, contributions and scores of many models are joins with it.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clean


def by_day(keys: list[str], window: int, lag: int = 1, day: str = "day"):
    """The frame [day - window, day - lag] over one row a day and key."""
    return Window.partitionBy(*keys).orderBy(F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))).rangeBetween(-window, -lag)


def window_values(rows: DataFrame, keys: list[str], value: Column, window: int, lag: int = 1, day: str = "day") -> DataFrame:
    """keys, day, values: all values of the window's days in order, for each day of the rows.

    A day's values travel once, as a sorted array; the window is put together where the key's days stand. Nulls are left out.
    """
    days = rows.groupBy(*keys, day).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    return days.select(*keys, day, F.array_sort(F.flatten(F.collect_list("_v").over(by_day(keys, window, lag, day)))).alias("values"))


def quantile(values: Column, q: float) -> Column:
    """Linear quantile of a sorted array; null of an empty one."""
    at = (F.size(values) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def _extent(rows: DataFrame, features: list[str], target: str) -> tuple[list[float], list[str]]:
    """A typical value of each feature and the target, taken off before squaring, and the features that are sometimes missing: one row."""
    own = [clean(F.col(f"`{c}`")) for c in [*features, target]]
    found = rows.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(own)], *[F.sum(c.isNull().cast("int")).alias(f"m{i}") for i, c in enumerate(own[:-1])]).first()
    shift = [float(found[f"a{i}"] or 0.0) for i in range(len(own))]
    return shift, [f for i, f in enumerate(features) if found[f"m{i}"]]


def daily_moments(rows: DataFrame, keys: list[str], features: list[str], target: str, shift: list[float], marked: list[str], day: str = "day") -> DataFrame:
    """keys, day, rows, moments, values: upper triangle of the sums of products, and the marked features' values; rows without a target count as rows only.

    One aggregate with partial sums. With p features it has some (2p)^2 / 2 sums, so p is some dozens at most.
    """
    y = clean(F.col(f"`{target}`"))
    x = [clean(F.col(f"`{c}`")) for c in features]
    parts = [F.lit(1.0), *[F.coalesce(c - s, F.lit(0.0)) for c, s in zip(x, shift, strict=False)], *[x[features.index(c)].isNull().cast("double") for c in marked], y - shift[-1]]
    sums = [F.coalesce(F.sum(F.when(y.isNotNull(), parts[i] * parts[j])), F.lit(0.0)) for i in range(len(parts)) for j in range(i, len(parts))]
    values = [F.collect_list(F.when(y.isNotNull(), x[features.index(c)])) for c in marked]
    return rows.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("rows"), F.array(*sums).alias("moments"), *[v.alias(f"_v{i}") for i, v in enumerate(values)])


def window_moments(daily: DataFrame, keys: list[str], window: int, size: int, marked: int, lag: int = 1, day: str = "day") -> DataFrame:
    """keys, day, rows, moments, medians (of the marked features; 0 where all are missing) of the window before each day."""
    w = by_day(keys, window, lag, day)
    held = daily.select(*keys, day, F.sum("rows").over(w).alias("rows"), F.array(*[F.sum(F.col("moments")[i]).over(w) for i in range(size)]).alias("moments"), *[F.collect_list(f"_v{i}").over(w).alias(f"_v{i}") for i in range(marked)])
    held = held.withColumns({f"_v{i}": F.array_sort(F.flatten(f"_v{i}")) for i in range(marked)}) if marked else held
    medians = F.array(*[F.coalesce(quantile(F.col(f"_v{i}"), 0.5), F.lit(0.0)) for i in range(marked)]) if marked else F.array().cast("array<double>")
    return held.select(*keys, day, "rows", "moments", medians.alias("medians"))


def solved(stats: DataFrame, features: list[str], marked: list[str], shift: list[float]) -> DataFrame:
    """``stats`` (moments, medians of the marked features, alpha) with n, means, scales, betas, level, seconds: one model a row, in batches.

    ``seconds`` is the model's share of the time that its batch took to solve.
    """
    p, k = len(features), len(marked)
    d = p + k + 2
    upper = np.triu_indices(d)
    base = np.array(shift)
    at = [features.index(c) for c in marked]

    def run(batches):
        for rows in batches:
            count = len(rows)
            if not count:
                continue
            began = time.perf_counter()
            m = np.zeros((count, d, d))
            flat = np.array(rows["moments"].tolist(), float)
            m[:, upper[0], upper[1]] = m[:, upper[1], upper[0]] = flat
            turn = np.zeros((count, p + 2, d))
            turn[:, 0, 0] = turn[:, -1, -1] = 1
            turn[:, range(1, p + 1), range(1, p + 1)] = 1
            if k:
                middle = np.array(rows["medians"].tolist(), float).reshape(count, k) - base[at]
                turn[:, [1 + i for i in at], range(p + 1, p + 1 + k)] = middle
            g = turn @ m @ turn.transpose(0, 2, 1)
            n = g[:, 0, 0][:, None]
            mean, level = g[:, 0, 1 : p + 1] / n, g[:, 0, -1] / n[:, 0]
            var = np.diagonal(g, axis1=1, axis2=2)[:, 1 : p + 1] / n - mean**2
            scale = np.sqrt(np.where(var <= 1e-10 * mean**2 + 1e-24, 1.0, var))  # a constant feature has no say
            gram = (g[:, 1 : p + 1, 1 : p + 1] / n[:, :, None] - mean[:, :, None] * mean[:, None, :]) / (scale[:, :, None] * scale[:, None, :]) * n[:, :, None]
            right = (g[:, 1 : p + 1, -1] / n - mean * level[:, None]) / scale * n
            beta = np.linalg.solve(gram + rows["alpha"].to_numpy(float)[:, None, None] * np.eye(p), right[:, :, None])[:, :, 0]
            yield rows.drop(columns=["moments", "medians"]).assign(n=n[:, 0].astype("int64"), means=list(mean + base[:p]), scales=list(scale), betas=list(beta), level=level + base[-1], seconds=(time.perf_counter() - began) / count)

    kept = [f"`{n}` {t}" for n, t in stats.dtypes if n not in ("moments", "medians")]
    return stats.where(F.col("moments")[0] > 0).mapInPandas(run, ", ".join([*kept, "n long, means array<double>, scales array<double>, betas array<double>, level double, seconds double"]))


def fit_windows(rows: DataFrame, features: list[str], target: str, window: int | list[int], least: int, alpha: float | list[float] = 1.0, keys: list[str] | None = None, lag: int = 1, day: str = "day") -> DataFrame:
    """keys, day, window, alpha, rows, n, means, scales, betas, level, middles, seconds: the model of each day's window [day - window, day - lag].

    ``rows`` are read a few times: give them written. Windows of under ``least`` rows, or without
    a target, have no model. Several windows and penalties are one job over the same daily sums.
    """
    keys = keys or []
    shift, marked = _extent(rows, features, target)
    size = (len(features) + len(marked) + 2) * (len(features) + len(marked) + 3) // 2
    daily = daily_moments(rows, keys, features, target, shift, marked, day)
    every = None
    for length in [window] if isinstance(window, int) else window:
        stats = window_moments(daily, keys, length, size, len(marked), lag, day).where(F.col("rows") >= least).withColumn("window", F.lit(length))
        every = stats if every is None else every.unionByName(stats)
    penalties = [alpha] if isinstance(alpha, (int, float)) else alpha
    every = every.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in penalties])))
    middles = F.array(*[F.col("medians")[marked.index(c)] if c in marked else F.lit(None).cast("double") for c in features])
    return solved(every.withColumn("middles", middles), features, marked, shift)


def scaled_features(features: list[str]) -> list[Column]:
    """Imputed and standardised features of rows joined with their model."""
    return [(F.coalesce(clean(F.col(f"`{c}`")), F.col("middles")[i], F.col("means")[i]) - F.col("means")[i]) / F.col("scales")[i] for i, c in enumerate(features)]


def prediction(features: list[str]) -> Column:
    value = F.col("level")
    for i, z in enumerate(scaled_features(features)):
        value = value + F.col("betas")[i] * z
    return value


def predict_windows(rows: DataFrame, models: DataFrame, features: list[str], keys: list[str] | None = None, day: str = "day") -> DataFrame:
    """``rows`` with window, alpha and y_pred of each model of their day and keys."""
    own = [*(keys or []), day]
    joined = rows.join(models.select(*own, "window", "alpha", "means", "scales", "betas", "level", "middles"), own)
    return joined.withColumn("y_pred", prediction(features)).drop("means", "scales", "betas", "level", "middles")


def contributions(rows: DataFrame, models: DataFrame, features: list[str], keys: list[str] | None = None, day: str = "day") -> DataFrame:
    """``rows`` with feature, scaled, beta, contribution (their product) and level; a row's contributions and its level add up to its prediction."""
    own = [*(keys or []), day]
    joined = rows.join(models.select(*own, "means", "scales", "betas", "level", "middles"), own)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), z.alias("scaled"), F.col("betas")[i].alias("beta")) for i, (c, z) in enumerate(zip(features, scaled_features(features), strict=True))])
    long = joined.withColumn("_p", F.explode(parts))
    return long.select(*rows.columns, "level", F.col("_p.feature").alias("feature"), F.col("_p.scaled").alias("scaled"), F.col("_p.beta").alias("beta"), (F.col("_p.scaled") * F.col("_p.beta")).alias("contribution"))


def fit_parts(rows: DataFrame, part: str, features: list[str], target: str, window: int, least: int, least_part: int, alpha: float = 1.0, keys: list[str] | None = None, lag: int = 1) -> DataFrame:
    """keys, day, part, n_part, fallback and a model: that of the part's own rows, or the one of all rows where the part has under ``least_part`` with a target.

    Parts are weather regimes or blocks of the day. The model of all rows is fitted once a day and shared by the parts that fall back.
    """
    keys = keys or []
    whole = fit_windows(rows, features, target, window, least, alpha, keys, lag)
    own = fit_windows(rows, features, target, window, 1, alpha, [*keys, part], lag)
    model = ["means", "scales", "betas", "level", "middles"]
    needed = rows.select(*keys, "day", part).distinct()
    joined = needed.join(whole.select(*keys, "day", "window", "alpha", F.struct(*model).alias("_w")), [*keys, "day"])
    joined = joined.join(own.select(*keys, "day", part, F.col("n").alias("_n"), F.struct(*model).alias("_o")), [*keys, "day", part], "left")
    n = F.coalesce("_n", F.lit(0).cast("long"))
    chosen = F.when(n >= least_part, F.col("_o")).otherwise(F.col("_w"))
    return joined.select(*keys, "day", part, "window", "alpha", n.alias("n_part"), (n < least_part).alias("fallback"), *[chosen[c].alias(c) for c in model])


def stack(rows: DataFrame, providers: list[str], target: str, window: int, least: int, alpha: float = 1.0, keys: list[str] | None = None, lag: int = 1, top: float | None = None) -> DataFrame:
    """``rows`` (keys, day, providers, target) with ``y_pred``: a rolling ridge over the providers' predictions.

    A provider without any prediction in the window has no say; a missing one takes its window's median. The mean
    of the providers that are there stands in where a row has none that the model knows, or the window
    has under ``least`` rows with a target and a provider. Predictions stay in [0, ``top``].
    """
    keys = keys or []
    there = F.coalesce(*[clean(F.col(f"`{c}`")) for c in providers]).isNotNull()
    train = rows.withColumn("_t", F.when(there, clean(F.col(f"`{target}`"))))
    models = fit_windows(train, providers, "_t", window, 1, alpha, keys, lag).where(F.col("n") >= least)
    seen = [F.sum(clean(F.col(f"`{c}`")).isNotNull().cast("int") * F.col("_t").isNotNull().cast("int")).alias(f"_k{i}") for i, c in enumerate(providers)]
    daily = train.groupBy(*keys, "day").agg(*seen)
    w = by_day(keys, window, lag)
    known = daily.select(*keys, "day", *[(F.coalesce(F.sum(f"_k{i}").over(w), F.lit(0)) > 0).alias(f"_u{i}") for i in range(len(providers))])
    joined = rows.join(known, [*keys, "day"]).join(models.select(*keys, "day", "means", "scales", "betas", "level", "middles"), [*keys, "day"], "left")
    has = [clean(F.col(f"`{c}`")).isNotNull() for c in providers]
    usable = F.lit(False)
    for i, h in enumerate(has):
        usable = usable | (h & F.col(f"_u{i}"))
    total, n = F.lit(0.0), F.lit(0)
    for c, h in zip(providers, has, strict=True):
        total, n = total + F.coalesce(clean(F.col(f"`{c}`")), F.lit(0.0)), n + h.cast("int")
    mean = F.when(n > 0, total / n)
    # A provider that the window never saw is constant there; its value now must not move the prediction.
    value = F.col("level")
    for i, z in enumerate(scaled_features(providers)):
        value = value + F.when(F.col(f"_u{i}"), F.col("betas")[i] * z).otherwise(0.0)
    y = F.greatest(F.when(F.col("level").isNotNull() & usable, value).otherwise(mean), F.lit(0.0))
    if top is not None:
        y = F.least(y, F.lit(top))
    fitted = F.col("level").isNotNull() & usable
    return joined.select(*rows.columns, F.when(mean.isNotNull() | fitted, y).alias("y_pred"), fitted.alias("fitted"))


def smeared(y: Column, mean_sinh: Column, mean_cosh: Column, center: Column, scale: Column) -> Column:
    """center + scale * mean(sinh(y + r)) over residuals r, from the means of their sinh and cosh: sinh(y + r) = sinh y cosh r + cosh y sinh r.

    So no prediction meets the residuals one by one. Without residuals (null means) the plain inverse.
    """
    return center + scale * (F.sinh(y) * F.coalesce(mean_cosh, F.lit(1.0)) + F.cosh(y) * F.coalesce(mean_sinh, F.lit(0.0)))


def score_settings(rows: DataFrame, features: list[str], target: str, windows: list[int], alphas: list[float], least: int, keys: list[str]) -> DataFrame:
    """keys, window, alpha, mae, n, rank: every setting's error over the days that all of a key's settings predict; rank 1 is the best."""
    models = fit_windows(rows, features, target, windows, least, alphas, keys)
    scored = predict_windows(rows, models, features, keys).where(F.col(target).isNotNull())
    # Settings are compared on the same days: those with a model of each.
    served = models.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == len(windows) * len(alphas)).select(*keys, "day")
    errors = scored.join(served, [*keys, "day"], "left_semi").groupBy(*keys, "window", "alpha").agg(F.avg(F.abs(F.col("y_pred") - F.col(target))).alias("mae"), F.count(F.lit(1)).alias("n"))
    return errors.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("mae", 9), "window", "alpha")))


def residual_smear(rows: DataFrame, models: DataFrame, feature: str, target: str, window: int, keys: list[str], lag: int = 1, day: str = "day") -> DataFrame:
    """keys, day, mean_sinh, mean_cosh of the training residuals of each day's one-feature model.

    Training rows come to a window as one array a day, so what is shuffled does not grow with the window; a model meets its rows where they stand.
    """
    pair = F.when(clean(F.col(target)).isNotNull(), F.struct(F.coalesce(clean(F.col(feature)), F.lit(float("nan"))).alias("x"), F.col(target).alias("y")))
    days = rows.groupBy(*keys, day).agg(F.collect_list(pair).alias("_v"))
    held = days.select(*keys, day, F.flatten(F.collect_list("_v").over(by_day(keys, window, lag, day))).alias("_v"))
    m = models.select(*keys, day, *[F.col(c)[0].alias(c) for c in ("means", "scales", "betas", "middles")], "level")
    j = held.join(m, [*keys, day])
    fill = F.coalesce("middles", "means")
    residual = F.transform("_v", lambda r: r["y"] - F.col("level") - F.col("betas") * (F.when(F.isnan(r["x"]), fill).otherwise(r["x"]) - F.col("means")) / F.col("scales"))
    mean = lambda f: F.aggregate("_r", F.lit(0.0), lambda a, r: a + f(r)) / F.size("_r")
    return j.withColumn("_r", residual).where(F.size("_r") > 0).select(*keys, day, mean(F.sinh).alias("mean_sinh"), mean(F.cosh).alias("mean_cosh"))


def weather_regime(cloud: Column | None, ratio: Column | None, clear_cloud: float = 35.0, overcast_cloud: float = 80.0, clear_ratio: float = 0.65, overcast_ratio: float = 0.35) -> Column:
    """clear, overcast or mixed from cloud cover and the irradiance's share of the clear sky's, of which one may be absent.

    Clear needs every given measure to say so and goes before overcast, which needs one. A missing value says neither.
    """
    clear, overcast = F.lit(True), F.lit(False)
    if cloud is not None:
        clear, overcast = clear & F.coalesce(cloud <= clear_cloud, F.lit(False)), overcast | F.coalesce(cloud >= overcast_cloud, F.lit(False))
    if ratio is not None:
        clear, overcast = clear & F.coalesce(ratio >= clear_ratio, F.lit(False)), overcast | F.coalesce(ratio <= overcast_ratio, F.lit(False))
    return F.when(clear, "clear").when(overcast, "overcast").otherwise("mixed")
