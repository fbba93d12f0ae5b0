"""Rolling-origin folds, scaling, selection and models that are fitted per fold."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linear import by_day


def rolling_folds(rows: DataFrame, day: str, window: int, least: int, lag: int = 1) -> DataFrame:
    """Rows with ``fold`` (delivery day) and ``split``: train rows of [fold - window, fold - lag], test rows of the fold.

    A range join as an equi-join: each row is exploded to the at most ``window`` folds it serves. Folds
    with fewer than ``least`` training rows go.
    """
    folds = rows.select(F.col(day).alias("fold")).distinct()
    test = rows.withColumn("fold", F.col(day)).withColumn("split", F.lit("test"))
    train = rows.withColumn("fold", F.explode(F.sequence(F.date_add(day, lag), F.date_add(day, window)))).join(folds, "fold", "left_semi")
    train = train.withColumn("split", F.lit("train")).select(*rows.columns, "fold", "split")
    enough = train.groupBy("fold").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("fold")
    return train.unionByName(test).join(enough, "fold", "left_semi")


def served_blocks(rows: DataFrame, day: str, window: int, lag: int = 1, size: int | None = None) -> DataFrame:
    """``rows`` for each block of ``size`` delivery days (half a window, if not given) that they serve, with ``_block`` and ``_at`` (days since 1970); rows without a day go."""
    size = size or max(1, window // 2)
    at = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    number = lambda c: F.floor(c / size).cast("int")
    serves = F.array_union(F.array(number(F.col("_at"))), F.sequence(number(F.col("_at") + lag), number(F.col("_at") + window)))
    return rows.withColumn("_at", at).where("_at IS NOT NULL").withColumn("_block", F.explode(serves))


def by_blocks(rows: DataFrame, keys: list[str], day: str, window: int, least: int, fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str, lag: int = 1, block: int | None = None) -> DataFrame:
    """What ``fit`` returns for each key and fold; it gets the fold's rows with ``fold`` (delivery day) and ``split``, as of ``rolling_folds``.

    For models that need their training rows. Days are cut into blocks of ``block`` delivery days (half a window, if not given), and a
    row goes to the blocks that it serves: 1 + window / block at most, so three whatever the window, where folds would take window + 1 copies.
    A group is the rows of one key in block + window days, however long the series. Folds with fewer than ``least``
    training rows go, as do rows without a day. An empty table gives no rows.
    """
    size = block or max(1, window // 2)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_at", kind="stable")
        days, first = own["_at"].to_numpy(), int(own["_block"].iat[0]) * size
        found = []
        for d in np.unique(days[(days >= first) & (days < first + size)]):
            a, z, b, e = np.searchsorted(days, [d - window, d - lag + 1, d, d + 1])
            if z - a >= max(least, 1):
                both = pd.concat([own.iloc[a:z].assign(split="train"), own.iloc[b:e].assign(split="test")], ignore_index=True)
                found.append(fit(both.assign(fold=np.datetime64(int(d), "D").astype(object)).drop(columns=["_at", "_block"])))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame()

    return served_blocks(rows, day, window, lag, size).groupBy(*keys, "_block").applyInPandas(run, schema)


def window_extremes(rows: DataFrame, keys: list[str], day: str, value: str, window: int, least: int, lag: int = 1) -> DataFrame:
    """keys, fold, lo, hi: extremes of the training rows in [fold - window, fold - lag], for each key and day of the rows.

    Folds with fewer than ``least`` training rows over all keys go, and keys without any in the window. A window takes the
    extremes of its days, so no row is copied. Missing values count as rows only; where all are missing, lo and hi are null.
    """
    daily = rows.groupBy(*keys, day).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    folds = F.explode(F.sequence(F.date_add(day, lag), F.date_add(day, window)))
    enough = daily.groupBy(day).agg(F.sum("_n").alias("_n")).select(folds.alias("fold"), "_n").groupBy("fold").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= least).select("fold")  # a few rows a day
    w = by_day(keys, window, lag, day)
    held = daily.select(*keys, F.col(day).alias("fold"), F.min("_lo").over(w).alias("lo"), F.max("_hi").over(w).alias("hi"), F.sum("_n").over(w).alias("_n"))
    return held.where("_n > 0").drop("_n").join(enough, "fold", "left_semi").select(*keys, "fold", "lo", "hi")


def scaled_between(value: Column, lo: Column, hi: Column) -> Column:
    """A value's place between two extremes; 0 where these do not differ."""
    return F.when(hi - lo > 1e-9, (value - lo) / (hi - lo)).otherwise(F.lit(0.0))


def robust_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """center, scale per key: median and MAD / 0.6745, or IQR / 1.349 where the MAD is 0, or 1."""
    center = df.groupBy(*keys).agg(F.median(value).alias("center"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    mad = df.join(center, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("center"))).alias("mad"), F.first("center").alias("center"), F.first("q").alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    scale = F.when(F.col("mad") > 0, F.col("mad") / 0.6745).when(iqr > 0, iqr / 1.349).otherwise(F.lit(1.0))
    return mad.select(*keys, "center", scale.alias("scale"))


def minmax_scale(folds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values scaled by their training split's extremes; degenerate features become 0."""
    train = folds.where("split = 'train'").groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return folds.join(train, keys).withColumn("scaled", scaled_between(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def top_correlated(long: DataFrame, keys: list[str], feature: str, value: str, target: str, k: int) -> DataFrame:
    """The k features with the largest absolute correlation to the target; constant ones never."""
    x, y = F.col(value), F.col(target)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))  # null, not an error, where constant
    g = long.groupBy(*keys, feature).agg(r.alias("r"), F.min(x).alias("lo"), F.max(x).alias("hi")).where("hi > lo AND r IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("r"), 9)), feature)
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, feature, "r", "rank")


def recency_weight(age_days: Column, half_life: float, keys: list[str]) -> Column:
    """0.5 ** (age / half-life), scaled to mean 1 over ``keys``."""
    raw = F.pow(F.lit(0.5), age_days / half_life)
    return raw / F.avg(raw).over(Window.partitionBy(*keys))


def ridge_by_fold(folds: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """fold, id, y_pred for the test rows: medians, standardisation and ridge, all from the training rows.

    One fold is one group; its size is the window, whatever the length of the series.
    """
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        for j, x, y, z in _parts(rows, [], features, target):
            mean, std = x.mean(axis=0), x.std(axis=0)
            std[std < 1e-12] = 1.0
            x, z = (x - mean) / std, (z - mean) / std
            beta = np.linalg.solve(x.T @ x + alpha * np.eye(len(features)), x.T @ (y - y.mean()))
            return pd.DataFrame({"fold": rows["fold"].to_numpy()[j], "id": rows["id"].to_numpy()[j], "y_pred": z @ beta + y.mean()})
        return pd.DataFrame({"fold": [], "id": [], "y_pred": []}, dtype=object)

    kind = dict(folds.dtypes)
    return folds.select("fold", "split", "id", target, *features).groupBy("fold").applyInPandas(fit, f"fold {kind['fold']}, id {kind['id']}, y_pred double")


def bounded_context(rows: DataFrame, keys: list[str], order: str, same: str, recent: int, weekday: int, older: int) -> DataFrame:
    """keys, order, part: per series at most ``recent`` last rows, the ``weekday`` last of the other rows where ``same`` holds, and ``older`` evenly spaced rows of the rest."""
    w = Window.partitionBy(*keys)
    n = rows.withColumn("_recent", F.row_number().over(w.orderBy(F.desc(order))) <= recent)
    mine = F.col(same) & ~F.col("_recent")
    n = n.withColumn("_same", mine & (F.row_number().over(Window.partitionBy(*keys, mine).orderBy(F.desc(order))) <= weekday))
    rest = ~F.col("_recent") & ~F.col("_same")
    n = n.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, rest).orderBy(order)) - 1).withColumn("_m", F.sum(rest.cast("int")).over(w))
    part = F.when(F.col("_recent"), "recent").when(F.col("_same"), "weekday").when(evenly_spaced(F.col("_m"), F.col("_i"), older), "older")
    return n.select(*keys, order, part.alias("part")).where("part IS NOT NULL")


def evenly_spaced(n: Column, i: Column, k: int) -> Column:
    """Whether row ``i`` (from 0) of ``n`` is one of ``k`` evenly spaced rows, ends included."""
    if k < 2:
        return i == 0
    step = F.greatest((n - 1) / (k - 1), F.lit(1e-9))
    j = F.round(i / step)
    return (n <= k) | ((F.round(j * step) == i) & (j <= k - 1))


def _parts(rows: pd.DataFrame, by: list[str], features: list[str], target: str):
    """For each value of ``by`` in one fold's rows that has training and test rows: the test rows' places, training matrix, target and test matrix.

    ``rows`` stand in order of ``by``. Missing features take the training median.
    """
    m, t = rows[features].to_numpy(float), rows[target].to_numpy(float)
    train, test = (rows["split"] == "train").to_numpy() & ~np.isnan(t), (rows["split"] == "test").to_numpy()
    edges = [0, len(rows)]
    if by and len(rows):
        keys = rows[by].to_numpy()
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        i, j = np.flatnonzero(train[a:z]) + a, np.flatnonzero(test[a:z]) + a
        if len(i) and len(j):
            x, v = m[i], m[j]
            middle = np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in x.T])
            yield j, np.where(np.isfinite(x), x, middle), t[i], np.where(np.isfinite(v), v, middle)


def lasso_path(x: np.ndarray, y: np.ndarray, penalties: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Coefficients for each penalty: minimise mean((y - x b)^2) / 2 + penalty * sum(abs(b)), columns of mean 0 and deviation 1 or 0.

    Accelerated proximal gradient steps on the Gram matrix, all penalties at once.
    """
    gram, right = x.T @ x / len(x), x.T @ y / len(x)
    step = 1 / max(float(np.linalg.norm(gram, 2)), 1e-12)
    beta = ahead = np.zeros((len(penalties), x.shape[1]))
    t, shrink = 1.0, step * penalties[:, None]
    for _ in range(rounds):
        z = ahead - step * (ahead @ gram - right)
        new = np.sign(z) * np.maximum(np.abs(z) - shrink, 0.0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = new - beta
        ahead, beta, t = new + (t - 1) / s * moved, new, s
        if np.abs(moved).max() < 1e-7:
            break
    return beta


def lasso_by_slot(rows: DataFrame, day: str, window: int, least: int, slot: str, features: list[str], target: str, parts: int = 3, grid: int = 6) -> DataFrame:
    """fold, slot, id, y_pred, alpha, intercept, coefficients (by feature, on standardised columns) for the test rows.

    One sparse linear model per fold and slot of the day: asinh of the robustly scaled target, standardised
    features, and the penalty with the least error over ``parts`` consecutive parts of the training rows. Folds are
    those of ``rolling_folds``, fitted by blocks of days.
    """

    def scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        std = x.std(axis=0)
        return x.mean(axis=0), np.where(std < 1e-12, np.inf, std)

    def one(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, float, float, list]:
        center = np.median(y)
        spread = np.median(np.abs(y - center)) / 0.6745 or y.std() or 1.0
        t = np.arcsinh((y - center) / spread)
        mean, std = scale(x)
        u, level = (x - mean) / std, t.mean()
        top = max(np.abs(u.T @ (t - level)).max() / len(u), 1e-9)
        penalties = top * np.logspace(0, -3, grid)
        loss = np.zeros(grid)
        for part in np.array_split(np.arange(len(u)), min(parts, len(u))) if len(u) > 1 else ():
            rest = np.setdiff1d(np.arange(len(u)), part)
            m, s = scale(x[rest])
            path = lasso_path((x[rest] - m) / s, t[rest] - t[rest].mean(), penalties)
            loss += ((((x[part] - m) / s) @ path.T + t[rest].mean() - t[part][:, None]) ** 2).sum(axis=0)
        best = int(np.argmin(np.round(loss, 12)))
        beta = lasso_path(u, t - level, penalties[best : best + 1])[0]
        return np.sinh(np.clip(((z - mean) / std) @ beta + level, -20, 20)) * spread + center, penalties[best], level, beta.tolist()

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([slot, "id"])
        out: list[tuple] = []
        for j, x, y, z in _parts(rows, [slot], features, target):
            pred, penalty, level, beta = one(x, y, z)
            out += [(i, p, penalty, level, beta) for i, p in zip(j, pred, strict=True)]
        own = rows.iloc[[i for i, *_ in out]][["fold", slot, "id"]]
        return own.assign(**{c: pd.Series([r[k + 1] for r in out], index=own.index, dtype=object) for k, c in enumerate(("y_pred", "alpha", "intercept", "coefficients"))})

    kind = dict(rows.dtypes)
    schema = f"fold date, {slot} {kind[slot]}, id {kind['id']}, y_pred double, alpha double, intercept double, coefficients array<double>"
    return by_blocks(rows.select(day, slot, "id", target, *features), [], day, window, least, fit, schema)


def boosted(x: np.ndarray, y: np.ndarray, z: np.ndarray, rounds: int = 15, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5) -> np.ndarray:
    """Predictions for ``z`` of regression trees boosted on squared error; features are binned by training quantiles."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = lambda m: np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, m.T, strict=True)], axis=1)
    cx, cz, size = code(x), code(z), bins + 1
    now, out = np.full(len(x), y.mean()), np.full(len(z), y.mean())
    for _ in range(rounds):
        residual, at_x, at_z = y - now, np.zeros(len(x), int), np.zeros(len(z), int)
        for _ in range(depth):
            nodes = at_x.max() + 1
            total = np.stack([np.bincount(at_x, minlength=nodes), np.bincount(at_x, residual, nodes)])
            best = np.zeros(nodes), np.zeros(nodes, int), np.full(nodes, size)  # gain, feature, last bin that goes left
            for j in range(x.shape[1]):
                cell = at_x * size + cx[:, j]
                left = np.stack([np.bincount(cell, minlength=nodes * size), np.bincount(cell, residual, nodes * size)]).reshape(2, nodes, size).cumsum(axis=2)
                right = total[:, :, None] - left
                ok = (left[0] >= least) & (right[0] >= least)
                gain = np.where(ok, left[1] ** 2 / np.maximum(left[0], 1) + right[1] ** 2 / np.maximum(right[0], 1) - (total[1] ** 2 / np.maximum(total[0], 1))[:, None], 0.0)
                cut = gain.argmax(axis=1)
                value = gain[np.arange(nodes), cut]
                better = value > best[0] + 1e-12
                for store, v in zip(best, (value, np.full(nodes, j), cut), strict=True):
                    store[better] = v[better]
            at_x = 2 * at_x + (cx[np.arange(len(x)), best[1][at_x]] > best[2][at_x])
            at_z = 2 * at_z + (cz[np.arange(len(z)), best[1][at_z]] > best[2][at_z])
        leaves = 2**depth
        leaf = rate * np.bincount(at_x, residual, leaves) / np.maximum(np.bincount(at_x, minlength=leaves), 1)
        now, out = now + leaf[at_x], out + leaf[at_z]
    return out


def boosted_by_fold(rows: DataFrame, day: str, window: int, least: int, configurations: dict[str, tuple[list[str], list[str]]], target: str) -> DataFrame:
    """configuration, fold, id, y_pred for the test rows: boosted trees for each fold, or each fold and block or slot of the day.

    A configuration has the columns that part a fold into models, and its features. All are fitted where the
    fold's rows stand, so the rows travel once for all of them, by blocks of days.
    """

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, (by, features) in configurations.items():
            own = own.sort_values([*by, "id"], ignore_index=True)
            for j, x, y, z in _parts(own, by, features, target):
                out.append(own.iloc[j][["fold", "id"]].assign(configuration=name, y_pred=boosted(x, y, z)))
        return pd.concat(out) if out else pd.DataFrame({"configuration": [], "fold": [], "id": [], "y_pred": []}, dtype=object)

    needed = dict.fromkeys(c for by, features in configurations.values() for c in (*by, *features))
    schema = f"configuration string, fold date, id {dict(rows.dtypes)['id']}, y_pred double"
    return by_blocks(rows.select(day, "id", target, *[c for c in needed if c not in (day, "id", target)]), [], day, window, least, fit, schema)
