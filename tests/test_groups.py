"""Groupings, exact quantiles, residual diagnostics and feature rules against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterlight.functions import features as N
from quarterlight.operators import groups as G

CORRECTION_BINS = 3


def forecast(spark, days=12, seed=3, slots=range(0, 96, 8)):
    """Two models over local winter days; some truths and predictions are missing, some predictions repeat."""
    rng, rows = random.Random(seed), []
    for model in ("a", "b"):
        for d in range(days):
            for m in slots:
                ts = dt.datetime(2026, 1, 4, 23) + dt.timedelta(days=d, minutes=15 * m)
                pred = None if rng.random() < 0.05 else float(rng.choice([10, 20, 30, rng.randrange(100)]))
                rows.append((model, ts, (ts + dt.timedelta(hours=1)).date(), pred, None if rng.random() < 0.1 else float(rng.randrange(100))))
    return spark.createDataFrame(rows, "model string, ts timestamp_ntz, day date, y_pred double, y_true double")


def edges_of(values, n_bins):
    values = np.asarray(values, float)
    values = values[np.isfinite(values)]
    if len(values) < max(2, n_bins):
        return None
    edges = np.unique(np.round(np.quantile(values, np.linspace(0, 1, max(2, n_bins) + 1)) + 1e-9, 6))
    return None if len(edges) < 3 else edges[1:-1]


def label_of(edges, v):
    return "all" if edges is None else "missing" if v is None or math.isnan(v) else str(sum(e < v for e in edges))


def key_of(grouping, ts, label):
    here = ts + dt.timedelta(hours=1)
    hour, mtu, kind = str(here.hour), str(here.hour * 4 + here.minute // 15), "weekend" if here.weekday() >= 5 else "weekday"
    return {
        "none": "none", "global": "global", "hour": hour, "mtu": mtu, "daytype_hour": f"{kind}_h{hour}", "daytype_mtu": f"{kind}_m{mtu}", "prediction_bin": label,
        "hour_prediction_bin": f"{hour}_b{label}", "mtu_prediction_bin": f"{mtu}_b{label}", "daytype_prediction_bin": f"{kind}_b{label}",
    }[grouping]


def test_corrections_equal_a_plain_day_loop(spark):
    df = forecast(spark)
    p = df.toPandas()
    got = {(r.model, r.ts, r.grouping): r for r in G.corrections(df, ["model"], G.GROUPINGS, 5, 4, CORRECTION_BINS, 0.5).collect()}
    assert len(got) == len(p) * len(G.GROUPINGS)
    for (model, day), own in p.groupby(["model", "day"]):
        past = p[(p.model == model) & (p.day >= day - dt.timedelta(days=5)) & (p.day < day)].dropna()
        edges = edges_of(past.y_pred, CORRECTION_BINS)
        for grouping in G.GROUPINGS:
            errors = {}
            for h in past.itertuples():
                errors.setdefault(key_of(grouping, h.ts, label_of(edges, h.y_pred)), []).append(h.y_pred - h.y_true)
            for r in own.itertuples():
                key = key_of(grouping, r.ts, label_of(edges, r.y_pred))
                mine = errors.get(key, [])
                want = 0.0 if grouping == "none" or len(past) < 4 else np.mean(mine) if len(mine) >= 4 else np.mean(past.y_pred - past.y_true)
                x = got[model, r.ts, grouping]
                assert x.group == key and x.correction == pytest.approx(want, abs=1e-9)
                if math.isnan(r.y_pred):
                    assert x.y_corrected is None
                else:
                    assert x.y_corrected == pytest.approx(max(0.0, r.y_pred - 0.5 * want), abs=1e-9)


def test_a_grouping_alone_gives_the_same_and_an_unknown_one_is_refused(spark):
    df = forecast(spark, 6)
    every = G.corrections(df, ["model"], G.GROUPINGS, 5, 4, CORRECTION_BINS)
    for g in ("none", "hour", "prediction_bin"):
        alone = G.corrections(df, ["model"], [g], 5, 4, CORRECTION_BINS)
        rows = lambda x: sorted((r.model, r.ts, r.group, round(r.correction, 9)) for r in x.where(F.col("grouping") == g).collect())
        assert rows(alone) == rows(every)
    with pytest.raises(ValueError):
        G.group_key("season", F.lit(1), F.lit(1), F.lit(True), F.lit("0"))


def test_empty_tables_have_no_corrections_and_no_diagnostics(spark):
    none = forecast(spark, 1).where("1 = 0")
    assert G.corrections(none, ["model"], G.GROUPINGS, 5, 4).count() == 0
    assert G.residual_diagnostics(none, ["model"]).count() == 0
    assert G.range_quantiles(none, ["model"], F.col("y_pred"), 4).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 5, 10])
def test_range_quantiles_are_exact_for_ties_hot_keys_and_odd_values(spark, parts):
    rng = random.Random(parts)
    rows = [("hot", float(rng.choice([1, 1, 1, rng.random() * 1000]))) for _ in range(6000)] + [("one", 7.5), ("two", -1.0), ("two", 3.0), ("odd", float("nan")), ("odd", float("inf")), ("odd", None), ("odd", 2.0)]
    got = {r.k: r for r in G.range_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), parts, splits=16).collect()}
    assert set(got) == {"hot", "one", "two", "odd"}
    for k, r in got.items():
        v = [x for key, x in rows if key == k and x is not None and math.isfinite(x)]
        assert r.n == len(v) and r.points == pytest.approx(np.quantile(v, np.linspace(0, 1, parts + 1)).tolist(), rel=1e-12)


def test_diagnostics_equal_pandas(spark):
    df = forecast(spark, 9, slots=range(0, 96, 4)).drop("day")
    got = {(r.model, r.dimension, r.level): r for r in G.residual_diagnostics(df, ["model"], 4, capacity={"a": 50.0}).collect()}
    seen = set()
    for model, own in df.toPandas().groupby("model"):
        own = own.set_index("ts")
        here = own.index + pd.Timedelta(hours=1)
        levels = {"hour": here.hour.astype(str), "mtu": (here.hour * 4 + here.minute // 15).astype(str), "month": here.strftime("%Y-%m"), "weekday": here.day_name(), "daytype": np.where(here.weekday >= 5, "weekend", "weekday")}
        values = {"actual_bin": own.y_true, "prediction_bin": own.y_pred}
        for h in (1, 3):
            values[f"actual_ramp_{h}h_bin"] = (own.y_true - own.y_true.reindex(own.index - pd.Timedelta(hours=h)).to_numpy()).abs()
        for name, v in values.items():
            edges = edges_of(v.dropna(), 4)
            levels[name] = [label_of(edges, x) for x in v]
        for dimension, level in levels.items():
            for value, e in (own.y_pred - own.y_true).groupby(np.asarray(level)):
                r, e = got[model, dimension, value], e.dropna()
                seen.add((model, dimension, value))
                assert r.n_obs == len(e)
                if len(e):
                    rmse = float(np.sqrt((e**2).mean()))
                    assert (r.mae, r.rmse, r.bias) == pytest.approx((e.abs().mean(), rmse, e.mean()), abs=1e-9)
                    assert r.nrmse_pct == (pytest.approx(2 * rmse) if model == "a" else None)
    assert seen == set(got) and len({d for _, d, _ in seen}) == 9


def test_constant_values_make_one_bin(spark):
    df = spark.createDataFrame([("a", dt.datetime(2026, 1, 5, h), 5.0, 4.0) for h in range(20)], "model string, ts timestamp_ntz, y_pred double, y_true double")
    got = {r.dimension: r for r in G.residual_diagnostics(df, ["model"]).where("dimension LIKE '%bin'").collect()}
    assert {r.level for r in got.values()} == {"all"} and got["prediction_bin"].n_obs == 20 and got["prediction_bin"].mae == 1.0


RULES = [
    ("EXAA_h10", "EXAA d", "EXAA prices", "Calendar/other", None, None),
    ("exaa_h10", "EXAA d", "EXAA prices", "EXAA price", None, None),
    ("price_d1_h03", "Price d-1", "Price lags", "Lagged price (day d-1)", None, None),
    ("price_d7_h03", "Price d-7", "Price lags", "Lagged price (day d-7)", None, None),
    ("load_d0_h03", "Load d", "Load forecast", "Load forecast", None, None),
    ("wind_speed_cluster_12_h03", "Wind d", "Raw weather", "Wind speed", 12, None),
    ("sw_dir_cluster_4_h12", "Solar d", "Raw weather", "Shortwave direct radiation", None, 4),
    ("ssrd_cluster_4", "Solar d", "Raw weather", "Calendar/other", None, None),
    ("weekday_3", "Weekday", "Calendar", "Calendar/other", None, None),
    ("is_holiday", "Holiday", "Calendar", "Calendar/other", None, None),
    ("is_15min_market", "15-min market dummy", "Calendar", "Calendar/other", None, None),
    ("Residual_Load_Proxy_MW_ramp_h01", "Other", "Residual load forecast", "Residual load ramp", None, None),
    ("Residual_Load_Proxy_MW_h01", "Other", "Residual load forecast", "Residual load", None, None),
    ("Renewable_Wind_h01", "Wind d", "Renewable forecast", "Wind generation", None, None),
    ("reserve_fcr_h01", "Other", "Reserve market", "Reserve market", None, None),
    ("", "Other", "Other", "Calendar/other", None, None),
    (None, "Other", "Other", "Calendar/other", None, None),
]


def test_feature_rules_take_the_first_match(spark):
    f = F.col("f")
    df = spark.createDataFrame([(r[0],) for r in RULES], "f string")
    got = df.select(f, N.feature_group(f), N.importance_group(f), N.subgroup(f), N.wind_cluster(f), N.solar_cluster(f)).collect()
    assert [tuple(r) for r in got] == RULES


def test_importance_sums_before_it_takes_absolute_values(spark):
    rng = random.Random(5)
    rows = [(s, f"g{rng.randrange(3)}" if rng.random() < 0.9 else None, rng.gauss(0, 1)) for s in range(40) for _ in range(6)]
    long = spark.createDataFrame(rows, "ts long, grp string, contribution double")
    p = pd.DataFrame(rows, columns=["ts", "grp", "c"]).dropna().groupby(["ts", "grp"]).c.sum().abs().groupby("grp").agg(["count", "mean", "median"])
    got = {r.grp: r for r in G.group_importance(long, ["ts"], "grp").collect()}
    assert set(got) == set(p.index)
    for g, w in p.iterrows():
        assert (got[g].n, got[g].mean_abs, got[g].median_abs, got[g].share) == pytest.approx((w["count"], w["mean"], w["median"], w["mean"] / p["mean"].sum()))
