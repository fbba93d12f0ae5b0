"""Scaling by feature kind against numpy."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterlight.functions.features import feature_kind
from quarterlight.operators import scaling as S

KINDS = [
    ("price_d1_h0", "price"), ("exaa_d0_h1", "price"), ("my_price_d1", "other"), ("wind_speed_cluster_1_h0", "wind"), ("Wind_Speed_x", "wind"), ("load_d0_h0", "load"), ("wind_speed_load", "load"),
    ("ssrd_cluster_0_h0", "radiation"), ("sw_dir_load", "radiation"), ("weekday_3", "calendar"), ("is_holiday", "calendar"), ("is_15min_market", "calendar"), ("spread", "other"),
]


def test_kinds_by_name(spark):
    got = spark.createDataFrame(KINDS, "f string, k string").select("f", feature_kind(F.col("f"))).collect()
    assert [tuple(r) for r in got] == KINDS


def reference(name, values, x):
    """What one value becomes under the constants of a window's values (None: missing)."""
    v = np.array([a for a in values if a is not None and np.isfinite(a)])
    kind = dict(KINDS).get(name, "other")
    if kind == "radiation" and (len(v) == 0 or v.max() - v.min() < 20 or (v > 0).sum() / len(values) < 0.5):
        return 0.0
    if kind in ("other", "radiation"):
        if not len(v):
            return 0.0
        return None if x is None else (x - v.min()) / ((v.max() - v.min()) or 1.0)
    if x is None:
        return None
    if kind == "calendar":
        return x
    center = np.median(v) if len(v) else 0.0
    mad = np.median(np.abs(v - center)) / 0.6744897501960817 if len(v) else 0.0
    z = (x - center) / (mad if mad > 1e-12 else 1.0)
    return np.arcsinh(z) if kind == "price" else z


def test_scaled_values_equal_numpy(spark):
    rng, rows = random.Random(11), []
    makers = {
        "price_d1_h0": lambda d: rng.gauss(50, 30), "wind_speed_cluster_1_h0": lambda d: rng.random() * 12, "load_d0_h0": lambda d: 5.0, "spread": lambda d: float(rng.randrange(5)), "weekday_3": lambda d: float(d % 7 == 3),
        "ssrd_cluster_0_h0": lambda d: max(0.0, rng.gauss(10, 40)) if d > 6 else rng.random() * 5, "sw_dir_load": lambda d: None if rng.random() < 0.6 else 100 * rng.random(), "nothing": lambda d: None, "flat": lambda d: 3.0 + (d == 11),
    }
    first = dt.date(2026, 1, 1)
    for d in range(12):
        for name, make in makers.items():
            for _ in range(6):
                v = make(d)
                rows.append((name, first + dt.timedelta(days=d), None if v is not None and rng.random() < 0.05 else v))
    long = spark.createDataFrame(rows, "feature string, day date, value double")
    scales = S.window_scales(long, [], 4, 10)
    got = S.scale_by_kind(long.withColumnRenamed("day", "fold"), scales, []).collect()
    want = []
    for name, day, x in rows:
        window = [v for n, at, v in rows if n == name and day - dt.timedelta(days=4) <= at < day]
        if len(window) >= 10:
            want.append((name, day, x, reference(name, window, x)))
    order = lambda r: (r[0], r[1], r[2] is None, r[2] or 0.0)
    got, want = sorted(((r.feature, r.fold, r.value, r.scaled) for r in got), key=order), sorted(want, key=order)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert (g[3] is None) == (w[3] is None) and (w[3] is None or g[3] == pytest.approx(w[3], abs=1e-9)), (g, w)


def test_a_least_range_of_the_middle_half(spark):
    day = dt.date(2026, 1, 1)
    rows = [("ssrd_cluster_0_h0", day, v) for v in [1.0, 50.0, 50.0, 50.0, 50.0, 99.0]] + [("ssrd_cluster_0_h0", day + dt.timedelta(days=1), 7.0)]
    long = spark.createDataFrame(rows, "feature string, day date, value double")
    degenerate = lambda **k: S.window_scales(long, [], 4, 2, **k).first().degenerate
    assert not degenerate() and degenerate(min_iqr=1.0)


def test_empty_table(spark):
    long = spark.createDataFrame([], "feature string, day date, value double")
    assert S.scale_by_kind(long.withColumnRenamed("day", "fold"), S.window_scales(long, [], 4, 2), []).count() == 0
