"""Window models from daily sums against fits of the rows themselves."""

import datetime as dt
import math
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterlight.operators import folds, linear

START = dt.date(2024, 3, 1)
SCHEMA = "id long, day date, area string, part string, a double, b double, c double, y double"


@pytest.fixture(scope="module")
def rows():
    """Two areas, some weeks; ``a`` and ``b`` are sometimes missing, ``c`` is constant for a while, targets are sometimes unknown."""
    rng = np.random.default_rng(8)
    out = []
    for k, area in enumerate(("x", "y")):
        for d in range(26):
            for i in range(0 if (d, k) == (11, 1) else int(rng.integers(4, 12))):
                a, b, c = rng.normal(1000, 5), rng.normal(), 7.0 if d < 12 else float(rng.integers(0, 3))
                y = 3 * a - 2 * b + c + rng.normal()
                out.append((len(out), START + dt.timedelta(d), area, ["s", "t", "u"][0 if rng.random() < 0.6 else 1 if rng.random() < 0.9 else 2],
                            None if rng.random() < 0.1 else float(a), math.nan if rng.random() < 0.15 else float(b), c, None if rng.random() < 0.1 else float(y)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def ridge(train, test, x, target, alpha):
    """Median imputation, standardisation and ridge by plain numpy; train and test are lists of dicts."""
    get = lambda rows: np.array([[math.nan if r[c] is None else r[c] for c in x] for r in rows], float).reshape(len(rows), len(x))
    m, z, y = get(train), get(test), np.array([r[target] for r in train], float)
    middle = np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in m.T])
    m, z = np.where(np.isfinite(m), m, middle), np.where(np.isfinite(z), z, middle)
    mean, std = m.mean(axis=0), m.std(axis=0)
    std[std < 1e-9] = 1.0
    m, z = (m - mean) / std, (z - mean) / std
    beta = np.linalg.solve(m.T @ m + alpha * np.eye(len(x)), m.T @ (y - y.mean()))
    return z @ beta + y.mean()


def as_dicts(rows):
    return [dict(zip(("id", "day", "area", "part", "a", "b", "c", "y"), r)) for r in rows]


def window_of(rows, day, window):
    return [r for r in rows if day - dt.timedelta(window) <= r["day"] < day]


def test_equals_a_fit_of_the_rows(frame):
    x = ["a", "b", "c"]
    one = frame.where("area = 'x'")
    got = {r["id"]: r["y_pred"] for r in linear.predict_windows(one, linear.fit_windows(one, x, "y", 9, 30, 2.0), x).collect()}
    want = {r["id"]: r["y_pred"] for r in folds.ridge_by_fold(folds.rolling_folds(one, "day", 9, 30), x, "y", 2.0).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_keys_windows_and_penalties_in_one_job(frame, rows):
    x = ["a", "b", "c"]
    models = linear.fit_windows(frame, x, "y", [5, 12], 20, [0.5, 40.0], ["area"])
    got = linear.predict_windows(frame, models, x, ["area"]).collect()
    own = as_dicts(rows)
    seen = 0
    for r in got:
        if r["id"] % 7 == 0:
            train = [t for t in window_of(own, r["day"], r["window"]) if t["area"] == r["area"]]
            assert len(train) >= 20
            known = [t for t in train if t["y"] is not None]
            assert abs(r["y_pred"] - ridge(known, [own[r["id"]]], x, "y", r["alpha"])[0]) < 1e-5
            seen += 1
    assert seen > 50


def test_contributions_add_up(frame):
    x = ["a", "b", "c"]
    models = linear.fit_windows(frame, x, "y", 9, 30, 1.0, ["area"])
    p = linear.predict_windows(frame, models, x, ["area"]).select("id", "y_pred")
    c = linear.contributions(frame, models, x, ["area"]).groupBy("id").agg((F.sum("contribution") + F.first("level")).alias("s"), F.count(F.lit(1)).alias("n"))
    both = c.join(p, "id").collect()
    assert len(both) == p.count() and all(r["n"] == 3 and abs(r["s"] - r["y_pred"]) < 1e-6 for r in both)


def test_parts_with_few_rows_share_the_whole_model(frame, rows):
    x, own = ["a", "b"], as_dicts(rows)
    models = linear.fit_parts(frame, "part", x, "y", 10, 40, 12, 1.0)
    got = linear.predict_windows(frame, models, x, ["part"]).collect()
    kinds = {(r["day"], r["part"]): r for r in models.collect()}
    assert {r["fallback"] for r in kinds.values()} == {True, False}
    for r in got:
        if r["id"] % 5 == 0:
            whole = [t for t in window_of(own, r["day"], 10) if t["y"] is not None]
            part = [t for t in whole if t["part"] == r["part"]]
            k = kinds[r["day"], r["part"]]
            assert k["n_part"] == len(part) and k["fallback"] == (len(part) < 12)
            assert abs(r["y_pred"] - ridge(whole if len(part) < 12 else part, [own[r["id"]]], x, "y", 1.0)[0]) < 1e-5


def test_stack_when_a_provider_drops_out(spark):
    rng = np.random.default_rng(3)
    data = []
    for d in range(20):
        for i in range(6):
            y = float(rng.uniform(5, 50))
            p, q, s = y + 4 + rng.normal() / 5, None if d >= 8 else y * 1.3 + rng.normal(), None if d < 12 or rng.random() < 0.3 else y - 2.0
            p = None if rng.random() < 0.2 else p
            data.append((len(data), START + dt.timedelta(d), p, q, s, None if rng.random() < 0.1 else y))
    df = spark.createDataFrame(data, "id long, day date, p double, q double, s double, y double")
    got = {r["id"]: r for r in linear.stack(df, ["p", "q", "s"], "y", 5, 10, 1.0, top=60.0).collect()}
    assert len(got) == len(data)
    own = [dict(zip(("id", "day", "p", "q", "s", "y"), r)) for r in data]
    fitted = 0
    for r in own:
        train = [t for t in window_of(own, r["day"], 5) if t["y"] is not None and any(t[c] is not None for c in "pqs")]
        usable = [c for c in "pqs" if any(t[c] is not None for t in train)]
        there = [r[c] for c in "pqs" if r[c] is not None]
        want = sum(there) / len(there) if there else None
        if len(train) >= 10 and any(r[c] is not None for c in usable):
            want, fitted = ridge(train, [r], usable, "y", 1.0)[0], fitted + 1
        if want is None:
            assert got[r["id"]]["y_pred"] is None
        else:
            assert abs(got[r["id"]]["y_pred"] - min(max(want, 0.0), 60.0)) < 1e-6
    assert fitted > 60


def test_best_setting_is_that_of_separate_runs(frame):
    x = ["a", "b"]
    scores = linear.score_settings(frame, x, "y", [6, 10], [1.0, 30.0], 25, ["area"]).collect()
    assert len(scores) == 8
    days = None
    runs = {}
    for w in (6, 10):
        for alpha in (1.0, 30.0):
            p = linear.predict_windows(frame, linear.fit_windows(frame, x, "y", w, 25, alpha, ["area"]), x, ["area"]).where("y IS NOT NULL").collect()
            runs[w, alpha] = p
            own = {(r["area"], r["day"]) for r in p}
            days = own if days is None else days & own
    for s in scores:
        e = [abs(r["y_pred"] - r["y"]) for r in runs[s["window"], s["alpha"]] if r["area"] == s["area"] and (r["area"], r["day"]) in days]
        assert s["n"] == len(e) and abs(s["mae"] - np.mean(e)) < 1e-9
    for area in "xy":
        assert min((s for s in scores if s["area"] == area), key=lambda s: s["mae"])["rank"] == 1


def test_window_values_and_quantiles(frame, rows):
    w = linear.window_values(frame, ["area"], F.when(~F.isnan("b"), F.col("b")), 6)
    got = w.select("area", "day", *[linear.quantile(F.col("values"), q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 1.0))]).collect()
    own = as_dicts(rows)
    for r in got:
        v = [t["b"] for t in window_of(own, r["day"], 6) if t["area"] == r["area"] and not math.isnan(t["b"])]
        assert [r["q0"], r["q1"], r["q2"]] == ([None] * 3 if not v else pytest.approx(np.quantile(v, [0.1, 0.5, 1.0]).tolist()))


def test_smearing_equals_the_mean_over_residuals(spark):
    rng = np.random.default_rng(9)
    data = [(i, START + dt.timedelta(i // 10), float(x), float(0.4 * x + rng.normal())) for i, x in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(data, "id long, day date, x double, y double").withColumn("k", F.lit("k"))
    models = linear.fit_windows(df, ["x"], "y", 4, 20, keys=["k"])
    p = linear.predict_windows(df, models, ["x"], ["k"]).join(linear.residual_smear(df, models, "x", "y", 4, ["k"]), ["k", "day"])
    got = p.select("day", "y_pred", linear.smeared(F.col("y_pred"), F.col("mean_sinh"), F.col("mean_cosh"), F.lit(2.0), F.lit(3.0)).alias("v")).collect()
    assert len(got) == 100
    for r in got[::9]:
        train = [dict(x=t[2], y=t[3]) for t in data if r["day"] - dt.timedelta(4) <= t[1] < r["day"]]
        res = np.array([t["y"] for t in train]) - ridge(train, train, ["x"], "y", 1.0)
        assert abs(r["v"] - (2 + 3 * np.mean(np.sinh(r["y_pred"] + res)))) < 1e-9


def test_functions_travel_by_value(tmp_path):
    """A session started in another folder, whose workers cannot import the package, fits models."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {root!r})
        from quarterlight.session import build_session
        from quarterlight.operators import folds, linear
        spark = build_session("t", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
        df = spark.sql("SELECT id, date_add(DATE'2024-01-01', CAST(id / 4 AS INT)) AS day, CAST(id % 5 AS DOUBLE) AS a, CAST(id AS DOUBLE) AS y FROM range(40)")
        assert linear.predict_windows(df, linear.fit_windows(df, ["a"], "y", 5, 8), ["a"]).count() == 32
        assert folds.ridge_by_fold(folds.rolling_folds(df, "day", 5, 8), ["a"], "y").count() == 32
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
