"""Calibration whose history is its own output, and whole-day sequence models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import by_blocks


def recursive_bias(forecast: DataFrame, keys: list[str], window: int, least: int, shrinkage: float) -> DataFrame:
    """keys, day, bias: shrunk mean of past *corrected* errors.

    A day's rows of one key share one correction, so daily error sums carry the recursion; a key has one
    row a day, summed before it is gathered.
    """
    daily = forecast.where("y_true IS NOT NULL").groupBy(*keys, "day").agg(F.sum(F.col("y_pred") - F.col("y_true")).alias("e"), F.count(F.lit(1)).alias("n"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")
        days = pd.to_datetime(rows["day"]).to_numpy()
        e, n = rows["e"].to_numpy(float), rows["n"].to_numpy(float)
        bias = np.zeros(len(rows))
        first = np.searchsorted(days, days - np.timedelta64(window, "D"))  # one row a day: the past is what stands from here to the row
        for i, a in enumerate(first):
            if n[a:i].sum() >= least:
                bias[i] = shrinkage * e[a:i].sum() / n[a:i].sum()
            e[i] -= n[i] * bias[i]
        return rows[[*keys, "day"]].assign(bias=bias)

    kinds = dict(daily.dtypes)
    return daily.groupBy(*keys).applyInPandas(walk, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "day"]) + ", bias double")


def day_sequences(df: DataFrame, keys: list[str], slots: int = 96) -> DataFrame:
    """keys, day, p, r: predictions and residuals of complete days as arrays in slot order."""
    own = df.where("y_true IS NOT NULL").groupBy(*keys, "day").agg(F.sort_array(F.collect_list(F.struct("mtu", "y_pred", "y_true"))).alias("s"))
    own = own.where((F.size("s") == slots) & (F.size(F.array_distinct(F.transform("s", lambda x: x["mtu"]))) == slots))
    return own.select(*keys, "day", F.transform("s", lambda x: x["y_pred"]).alias("p"), F.transform("s", lambda x: x["y_true"] - x["y_pred"]).alias("r"))


def sequence_correction(days: DataFrame, keys: list[str], window: int, least: int, alpha: float = 10.0) -> DataFrame:
    """keys, day, correction (array): ridge of the next day's residuals on its trajectory, fitted on past complete days.

    A group is the days of one key that a block of delivery days needs; a day travels three times at most, whatever the window.
    """

    def shape(p: np.ndarray) -> np.ndarray:
        hourly = p.reshape(len(p), -1, 4).mean(axis=2)
        return np.column_stack([hourly, np.diff(hourly, axis=1), hourly.mean(axis=1), hourly.std(axis=1)])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        train, test = rows[rows["split"] == "train"], rows[rows["split"] == "test"]
        out = test[[*keys, "day"]]
        x, z = shape(np.stack(train["p"].to_list())), shape(np.stack(test["p"].to_list()))
        y = np.stack(train["r"].to_list())
        mean, std = x.mean(axis=0), x.std(axis=0)
        std[std < 1e-12] = 1.0
        x, z = (x - mean) / std, (z - mean) / std
        beta = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean(axis=0)))
        return out.assign(correction=list(z @ beta + y.mean(axis=0)))

    kinds = dict(days.dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "day date, correction array<double>"
    return by_blocks(days, keys, "day", window, least, fit, schema)


#: How rows are grouped for corrections and quantiles: parts of "hour", "mtu", "kind" (of day) and "bin" (of prediction), joined by "_"; "global" is one group.
GROUPS = ("none", "global", "hour", "mtu", "kind", "kind_hour", "kind_mtu", "bin", "kind_bin", "hour_bin")


@dataclass(frozen=True)
class Postprocess:
    """Windows are days before the delivery day's own, ``lag`` of which are not known yet beyond the last; a step without a window is left out."""

    lag: int = 1
    bins: int = 4
    group: str = "kind_bin"
    window: int = 14
    least: int = 24
    shrinkage: float = 0.5
    calibrator_window: int = 14
    calibrator_least: int = 96
    alpha: float = 10.0
    blend: float = 0.5
    quantile_group: str = "hour"
    quantile_window: int = 14
    quantile_least: int = 12
    spread: float = 1.0
    taus: tuple[float, ...] = (0.1, 0.5, 0.9)
    top: float = float("inf")


def _labels(group: str, parts: dict[str, np.ndarray], edges: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """One whole number a row: its group."""
    out = np.zeros(len(pred), np.int64)
    if group != "global":
        for name in group.split("_"):
            # A bin is right-closed: how many distinct edges lie below the prediction.
            out = out * 1000 + (np.searchsorted(edges, pred, side="left") if name == "bin" else parts[name])
    return out


def _edges(pred: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(pred, np.arange(1, bins) / bins)) if len(pred) else np.zeros(0)


def postprocess_days(forecast: DataFrame, keys: list[str], how: Postprocess = Postprocess()) -> DataFrame:
    """keys, ts, day, y_base, y_pred, y_true, quantiles (array by ``how.taus``; null where too little is known).

    Day by day, each series carries its own corrected history through grouped bias correction, the
    point calibrator and residual quantiles; a group with too few rows takes the error of all, and without these none. ``forecast`` has keys, ts,
    day, hour, mtu, kind, y_pred, y_true; rows of equal ts are separate. One series is one
    group: its days depend on each other. Series run side by side, each with pointers into its days.
    """
    if how.group not in GROUPS or how.quantile_group not in GROUPS:
        raise ValueError(f"group must be one of {', '.join(GROUPS)}")

    def design(pred: np.ndarray, hour: np.ndarray, kind: np.ndarray) -> np.ndarray:
        angle = 2 * np.pi * hour / 24
        return np.column_stack([pred, np.sin(angle), np.cos(angle), kind])

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["day", "ts", "y_pred"], kind="stable").reset_index(drop=True)
        day = (pd.to_datetime(rows["day"]).to_numpy().astype("datetime64[D]")).astype(np.int64)
        base, true = rows["y_pred"].to_numpy(float), rows["y_true"].to_numpy(float)
        parts = {c: rows[c].to_numpy(np.int64) for c in ("hour", "mtu", "kind")}
        out, spreads = base.copy(), [None] * len(rows)
        days, first = np.unique(day, return_index=True)
        last = [*first[1:], len(rows)]

        def history(d: int, window: int) -> np.ndarray:
            a, z = np.searchsorted(days, [d - window, d - how.lag + 1])
            a, z = (first[i] if i < len(days) else len(rows) for i in (a, z))
            at = np.arange(a, z)
            return at[np.isfinite(true[at]) & np.isfinite(out[at])]

        pick = lambda at: {c: v[at] for c, v in parts.items()}
        for d, a, z in zip(days, first, last, strict=True):
            now = np.arange(a, z)
            if how.window and how.group != "none":
                h = history(d, how.window)
                if len(h) >= how.least:
                    e, edges = out[h] - true[h], _edges(out[h], how.bins)
                    names, place, n = np.unique(_labels(how.group, pick(h), edges, out[h]), return_inverse=True, return_counts=True)
                    mean = np.bincount(place, e) / n
                    own = _labels(how.group, pick(now), edges, out[now])
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    out[now] -= how.shrinkage * np.where((names[at] == own) & (n[at] >= how.least), mean[at], e.mean())
                    out[now] = np.clip(out[now], 0, how.top)
            if how.calibrator_window:
                h = history(d, how.calibrator_window)
                if len(h) >= how.calibrator_least:
                    x, z_ = (design(out[i], parts["hour"][i], parts["kind"][i]) for i in (h, now))
                    mean, std = x.mean(axis=0), x.std(axis=0)
                    std[std < 1e-9] = 1.0
                    x, y = (x - mean) / std, true[h] - out[h]
                    beta = np.linalg.solve(x.T @ x + how.alpha * np.eye(4), x.T @ (y - y.mean()))
                    out[now] = np.clip(out[now] + how.blend * ((z_ - mean) / std @ beta + y.mean()), 0, how.top)
            if how.quantile_window and how.quantile_group != "none":
                h = history(d, how.quantile_window)
                if len(h) >= how.quantile_least:
                    r, edges = true[h] - out[h], _edges(out[h], how.bins)
                    groups, own = (_labels(how.quantile_group, pick(i), edges, out[i]) for i in (h, now))
                    whole = np.quantile(r, how.taus)
                    middle = np.quantile(r, 0.5)
                    known: dict[int, tuple] = {}
                    for i, g in zip(now, own, strict=True):
                        if g not in known:
                            mine = r[groups == g]
                            known[g] = (np.quantile(mine, how.taus), np.quantile(mine, 0.5)) if len(mine) >= how.quantile_least else (whole, middle)
                        q, m = known[g]
                        spreads[i] = np.maximum.accumulate(np.clip(out[i] + m + how.spread * (q - m), 0, how.top)).tolist()
        return rows[[*keys, "ts", "day"]].assign(y_base=base, y_pred=out, y_true=true, quantiles=spreads)

    kinds = dict(forecast.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "ts", "day"]) + ", y_base double, y_pred double, y_true double, quantiles array<double>"
    done = forecast.select(*keys, "ts", "day", "hour", "mtu", "kind", "y_pred", "y_true").groupBy(*keys).applyInPandas(walk, schema)
    return done.withColumn("y_true", F.when(~F.isnan("y_true"), F.col("y_true")))


def component_totals(parts: DataFrame, series: str, name: str, least: int) -> DataFrame:
    """ts, series = ``name``, y_pred, y_true: sums over the series where at least ``least`` of them stand; the truth only if all of these have one."""
    n = F.count(F.lit(1))
    total = parts.groupBy("ts").agg(n.alias("_n"), F.sum("y_pred").alias("y_pred"), F.when(F.count("y_true") == n, F.sum("y_true")).alias("y_true"))
    return total.where(F.col("_n") >= least).select("ts", F.lit(name).alias(series), "y_pred", "y_true")
