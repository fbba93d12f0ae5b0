"""Models that need their training rows are fitted by blocks of days: same folds, few copies."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quarterlight.operators import folds as M
from quarterlight.operators import recursive as RC

START = dt.date(2026, 1, 1)


def series(seed, days=50, share=0.8):
    """(key, day, id, v): some days missing, some with several rows, equal rows, missing values and rows without a day."""
    rng = np.random.default_rng(seed)
    rows = []
    for key in ("a", "b", None):
        for n in range(days):
            if rng.random() < share:
                rows += [(key, START + dt.timedelta(n), int(i), None if rng.random() < 0.1 else float(np.round(rng.normal(), 3))) for i in range(rng.integers(1, 4))]
        rows += [rows[-1], (key, None, 0, 1.0)]
    return rows


SCHEMA = "key string, day date, id int, v double"


@pytest.mark.parametrize(("window", "lag", "block"), [(7, 1, None), (5, 2, 1), (10, 0, 4), (3, 1, 20), (2, 1, None), (14, 9, 2)])
def test_blocks_hold_the_rows_of_every_fold(spark, window, lag, block):
    rows = series(window)
    df = spark.createDataFrame(rows, SCHEMA)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        return own[["key", "fold", "split", "day", "id", "v"]]

    got = M.by_blocks(df, ["key"], "day", window, 4, fit, "key string, fold date, split string, day date, id int, v double", lag, block).collect()
    want = []
    for key in ("a", "b", None):
        own = [r for r in rows if r[0] == key and r[1]]
        for fold in {r[1] for r in own}:
            train = [r for r in own if fold - dt.timedelta(window) <= r[1] <= fold - dt.timedelta(lag)]
            if len(train) >= 4:
                want += [(key, fold, "train", *r[1:]) for r in train] + [(key, fold, "test", *r[1:]) for r in own if r[1] == fold]
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert want and order(got) == order(want)


def test_a_row_goes_to_three_blocks_at_most(spark):
    df = spark.createDataFrame([("a", START + dt.timedelta(n), n, 1.0) for n in range(400)], SCHEMA)
    for window in (6, 28, 180):
        def size(own: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"n": [len(own)], "fold": own["fold"].iloc[:1]})

        plan = M.by_blocks(df, [], "day", window, 1, size, "n int, fold date")
        got = {r.fold: r.n for r in plan.collect()}
        assert len(got) == 399 and got[START + dt.timedelta(399)] == min(window, 399) + 1
        copies = M.served_blocks(df, "day", window).groupBy("id").count().agg({"count": "max"}).first()[0]
        assert copies <= 3


def test_extremes_of_windows_equal_those_of_folds(spark):
    rows = [r for r in series(3) if r[1] and r[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    for window, least, lag in ((7, 15, 1), (5, 1, 2)):
        got = {(r.key, r.fold): (r.lo, r.hi) for r in M.window_extremes(df, ["key"], "day", "v", window, least, lag).collect()}
        want = {}
        for key, fold in {(r[0], r[1]) for r in rows}:
            inside = [r for r in rows if fold - dt.timedelta(window) <= r[1] <= fold - dt.timedelta(lag)]
            own = [r[3] for r in inside if r[0] == key]
            if len(inside) >= least and own:
                values = [v for v in own if v is not None]
                want[key, fold] = (min(values), max(values)) if values else (None, None)
        assert want and got == want


def test_sequence_corrections_equal_a_plain_fit_on_the_window(spark):
    rng = np.random.default_rng(5)
    days = []
    for key in ("a", "b"):
        for n in range(25):
            if (key, n) not in {("a", 4), ("a", 5), ("b", 20)}:
                p = rng.uniform(0, 50, 96)
                days.append((key, START + dt.timedelta(n), p.tolist(), (0.1 * p + rng.normal(size=96)).tolist()))
    df = spark.createDataFrame(days, "model string, day date, p array<double>, r array<double>")
    got = {(r.model, r.day): np.array(r.correction) for r in RC.sequence_correction(df, ["model"], 8, 5, 2.0).collect()}

    def shape(p):
        hourly = p.reshape(24, 4).mean(axis=1)
        return np.array([*hourly, *np.diff(hourly), hourly.mean(), hourly.std()])

    want = {}
    for key, day, p, _ in days:
        past = [d for d in days if d[0] == key and 1 <= (day - d[1]).days <= 8]
        if len(past) >= 5:
            x, y = np.array([shape(np.array(d[2])) for d in past]), np.array([d[3] for d in past])
            mean, std = x.mean(axis=0), x.std(axis=0)
            u, z = (x - mean) / std, (shape(np.array(p)) - mean) / std
            want[key, day] = z @ np.linalg.solve(u.T @ u + 2.0 * np.eye(49), u.T @ (y - y.mean(axis=0))) + y.mean(axis=0)
    assert got.keys() == want.keys() and len(want) > 30
    assert all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_empty_tables_give_no_models(spark):
    df = spark.createDataFrame([], "day date, id int, slot int, a double, y double")
    assert M.lasso_by_slot(df, "day", 7, 3, "slot", ["a"], "y").count() == 0
    assert M.boosted_by_fold(df, "day", 7, 3, {"whole": ([], ["a"])}, "y").count() == 0
    assert M.window_extremes(df, ["slot"], "day", "y", 7, 3).count() == 0
    few = spark.createDataFrame([(START, 1, 0, 1.0, 2.0)], df.schema)
    assert M.lasso_by_slot(few, "day", 7, 3, "slot", ["a"], "y").count() == 0
