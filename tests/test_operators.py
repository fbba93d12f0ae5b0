"""Small fixtures with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterlight.functions import numeric as N
from quarterlight.functions import text as X
from quarterlight.functions import time as T
from quarterlight.operators import calendar as C
from quarterlight.operators import capacity as P
from quarterlight.operators import evaluation as E
from quarterlight.operators import folds as M
from quarterlight.operators import grid as G
from quarterlight.operators import lags as L
from quarterlight.operators import spatial as S
from quarterlight.operators import weather as W


def frame(spark, rows, schema):
    """A DataFrame whose ``ts``, ``start`` and ``end`` columns are UTC instants without zone."""
    df = spark.createDataFrame(rows, schema)
    for name, kind in df.dtypes:
        if name in ("ts", "start", "end") and kind == "string":
            df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
        if name == "day" and kind == "string":
            df = df.withColumn(name, F.col(name).cast("date"))
    return df


def quarter_hours(spark, start, n):
    first = dt.datetime.fromisoformat(start)
    return frame(spark, [((first + dt.timedelta(minutes=15 * i)).isoformat(sep=" "), float(i)) for i in range(n)], "ts string, v double")


def test_daylight_saving_days_have_92_and_100_slots(spark):
    days = frame(spark, [("2026-03-29",), ("2026-10-25",), ("2026-01-10",)], "day string")
    got = {str(r.day): r.n for r in days.select("day", T.slots(F.col("day")).alias("n")).collect()}
    assert got == {"2026-03-29": 92, "2026-10-25": 100, "2026-01-10": 96}


def test_complete_short_day_is_not_reported(spark):
    day = quarter_hours(spark, "2026-03-28 23:00:00", 92)
    assert G.incomplete_days(day, []).count() == 0
    missing = day.withColumn("v", F.when(F.col("v") != 5, F.col("v")))
    assert [str(r.start) for r in G.incomplete_days(missing, []).collect()] == ["2026-03-29"]


def test_cutoffs(spark):
    days = frame(spark, [("2026-01-10",)], "day string")
    r = days.select(L.cutoff(F.col("day")).alias("a"), L.cutoff(F.col("day"), hour=10, minute=15).alias("b")).first()
    assert (str(r.a), str(r.b)) == ("2026-01-09 22:45:00", "2026-01-09 09:15:00")


def test_lag_is_by_time_not_by_row(spark):
    s = quarter_hours(spark, "2026-01-01 00:00:00", 960).where("v <> 10")
    got = L.lag_by_time(s, [], [2]).where("v IN (202, 300)").orderBy("v").collect()
    assert [r.v_lag_2d for r in got] == [None, 108.0]


def test_bounded_fill_and_incomplete_days(spark):
    hourly = quarter_hours(spark, "2026-01-09 23:00:00", 96).where("v % 4 = 0")
    filled = G.expand_hourly(hourly, [])
    assert filled.where("v IS NULL").count() == 0 and filled.count() == 96
    assert G.expand_hourly(hourly.where("v <> 40"), []).where("v IS NOT NULL").count() == 0


def test_interpolation_stops_at_the_limit(spark):
    rows = [(1, k, float(k) if k in (0, 10) else None) for k in range(12)]
    got = G.interpolate_in_day(frame(spark, rows, "day int, mtu int, v double"), ["day"], "mtu", "v", 4).orderBy("mtu").collect()
    assert [r.v for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0, None, None, None, None, None, 10.0, None]


def test_outages_add_up_in_half_open_intervals(spark):
    rows = [("2026-01-01 00:00:00", "2026-01-01 01:00:00", 60.0), ("2026-01-01 00:30:00", "2026-01-01 01:15:00", 70.0)]
    got = G.interval_load(frame(spark, rows, "start string, end string, mw double"), [], "mw").orderBy("ts").collect()
    assert [r.mw for r in got] == [60.0, 60.0, 130.0, 130.0, 70.0]


def test_day_summary_of_a_ramp(spark):
    r = G.day_summary(quarter_hours(spark, "2026-01-09 23:00:00", 96), []).first()
    assert (r["mean"], r["max_ramp"], r["morning_mean"], r["evening_max"]) == (47.5, 4.0, 35.5, 75.0)


def test_bridge_day(spark):
    days = frame(spark, [("2026-05-13",), ("2026-05-14",), ("2026-05-15",)], "day string")
    flags = {str(r.day): r for r in C.day_flags(days, frame(spark, [("2026-05-14",)], "day string")).collect()}
    assert flags["2026-05-15"].is_bridge_day == 1 and flags["2026-05-13"].is_pre_holiday == 1 and flags["2026-05-14"].is_holiday == 1


def test_regional_holiday_share(spark):
    days, hol = frame(spark, [("2026-01-06",)], "day string"), frame(spark, [("DE1", "2026-01-06")], "region string, day string")
    r = C.regional_shares(days, hol, spark.createDataFrame([("DE1", 2.0), ("LU0", 1.0)], "region string, weight double")).first()
    assert r.is_holiday_share == pytest.approx(2 / 3)


def test_point_metrics_skip_nulls(spark):
    df = spark.createDataFrame([("m", 12.0, 10.0), ("m", 18.0, 20.0), ("m", 33.0, 30.0), ("m", 5.0, None)], "model string, y_pred double, y_true double")
    r = E.point_metrics(df, ["model"]).first()
    assert (r.mae, r.rmse, r.bias, r.n_obs, r.n_missing) == (pytest.approx(7 / 3), pytest.approx((17 / 3) ** 0.5), 1.0, 3, 1)


def test_holm(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p_value double")
    assert [r.p_holm for r in E.holm(df, []).orderBy("p_value").collect()] == [pytest.approx(0.03), pytest.approx(0.06), pytest.approx(0.06)]


def test_capacity_in_service(spark):
    units = frame(spark, [("a", "2020-01-10 00:00:00", None, 10.0), ("a", "2020-02-15 00:00:00", None, 20.0), ("b", "2020-01-01 00:00:00", "2020-02-01 00:00:00", 5.0)], "region string, start string, end string, mw double")
    days = frame(spark, [("2020-02-01",), ("2020-03-01",)], "day string")
    got = {(r.region, str(r.day)): r.mw for r in P.active(units, ["region"], days).collect()}
    assert got == {("a", "2020-02-01"): 10.0, ("a", "2020-03-01"): 30.0, ("b", "2020-02-01"): 0.0, ("b", "2020-03-01"): 0.0}


def test_cell_mean_falls_back_without_weight(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 3.0), (2, 100.0, 0.0)], "c int, v double, w double")
    assert {r.c: r.v for r in S.cell_mean(df, ["c"], "v", "w").collect()} == {1: 17.5, 2: 100.0}


def test_nearest_join_agrees_whole_and_by_cells(spark):
    spark.sparkContext.setCheckpointDir("/tmp/quarterlight-test-checkpoints")
    left = spark.range(200).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    points = spark.range(50).select(F.col("id").alias("p"), F.rand(3).alias("x"), F.rand(4).alias("y"))
    left, points = left.persist(), points.persist()
    whole = {r.id: r.p for r in S.nearest(left, points, "p").collect()}
    cells = {r.id: r.p for r in S.nearest(left, points, "p", count=10**9).collect()}
    assert whole == cells and len(whole) == 200


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1, c, v, w) for c, v, w in ((0, 10.0, 1.0), (1, 20.0, 1.0), (2, 30.0, 8.0))], "k int, c int, v double, w double")
    r = W.weighted_quantiles(df, ["k"], "v", "w", [0.1, 0.5, 0.9], "c").first()
    assert (r.q10, r.q50, r.q90) == (10.0, 30.0, 30.0)


def test_inertia_window(spark):
    df = quarter_hours(spark, "2026-01-01 00:00:00", 12)
    r = W.inertia(df, [], "v", 1).where("v = 4").first()
    assert (r["mean"], r["range"], r["delta"]) == (2.5, 3.0, 1.5)


def test_german_numbers_and_tokens(spark):
    df = spark.createDataFrame([("1.234,5",), ("-",), (None,)], "x string")
    assert [r[0] for r in df.select(X.german_number(F.col("x"))).collect()] == [1234.5, None, None]
    df = spark.createDataFrame([("LU0-BE3",)], "x string")
    assert df.select(X.tokens_with_prefix(F.col("x"), ["LU"])).first()[0] == ["LU0"]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "x double")
    assert [r[0] for r in df.select(N.clip(F.col("x"), 0.0, 1.0)).collect()] == [None, 1.0]


def test_folds_use_only_the_past(spark):
    rows = frame(spark, [(f"2026-01-{k:02d}", float(k)) for k in range(1, 15)], "day string, v double")
    f = M.rolling_folds(rows, "day", 5, 5)
    assert f.where("split = 'train' AND day >= fold").count() == 0
    assert f.where("split = 'train'").groupBy("fold").count().where("count <> 5").count() == 0


def test_ridge_recovers_a_line(spark):
    rows = frame(spark, [(f"2026-01-{k:02d}", k, float(k), 3.0 * k + 1) for k in range(1, 29)], "day string, id int, x double, y double")
    got = M.ridge_by_fold(M.rolling_folds(rows, "day", 10, 10), ["x"], "y", 1e-6).collect()
    assert got and all(abs(r.y_pred - (3 * r.id + 1)) < 1e-3 for r in got)


def test_outage_load_agrees_with_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = []
    for k in range(60):
        a = dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randint(0, 3000))
        rows.append(("ab"[k % 2], a, a + dt.timedelta(minutes=rng.randint(1, 600)), float(rng.randint(1, 9))))
    df = spark.createDataFrame(rows, "k string, start timestamp_ntz, end timestamp_ntz, mw double")
    want = {}
    for key, a, z, mw in rows:
        at = dt.datetime(2026, 1, 1)
        while at < z:
            if at >= a:
                want[key, at] = want.get((key, at), 0.0) + mw
            at += dt.timedelta(minutes=15)
    assert {(r.k, r.ts): r.mw for r in G.interval_load(df, ["k"], "mw").collect()} == want


def test_fleet_statistics_agree_with_brute_force(spark):
    units = frame(spark, [("a", "2020-01-10 00:00:00", None, 10.0, 1), ("a", "2020-01-20 00:00:00", "2020-03-01 00:00:00", 30.0, 2), ("a", "2020-01-20 00:00:00", "2020-02-01 00:00:00", 5.0, 2)], "region string, start string, end string, mw double, part int")
    days = frame(spark, [("2020-02-01",), ("2020-03-01",), ("2019-01-01",)], "day string")
    got = {str(r.day): r for r in P.fleet_statistics(units, ["region"], days, "part", 15).collect()}
    assert set(got) == {"2020-02-01", "2020-03-01"}
    r = got["2020-02-01"]
    assert (r.mw, r.units, r.mean_mw, r.max_mw, r.parts) == (40.0, 2, 20.0, 30.0, 2)
    assert (r.age_days, r.recent_share, r.hhi) == (pytest.approx((10 * 22 + 30 * 12) / 40), pytest.approx(0.75), pytest.approx(0.625))


def test_keep_last_allows_any_column_names(spark):
    df = spark.createDataFrame([(1, 1, 5, 7), (1, 2, 6, 8)], "k int, t int, _rank int, rank int")
    assert [tuple(r) for r in G.keep_last(df, ["k"], "t").collect()] == [(1, 2, 6, 8)]


def test_context_is_bounded(spark):
    rows = spark.range(1000).select(F.col("id").alias("ts"), (F.col("id") % 7 == 3).alias("same"))
    got = {}
    for r in M.bounded_context(rows, [], "ts", "same", 50, 20, 30).collect():
        got.setdefault(r.part, []).append(r.ts)
    assert sorted(got["recent"]) == list(range(950, 1000))
    assert sorted(got["weekday"]) == [x for x in range(950) if x % 7 == 3][-20:]
    rest = [x for x in range(950) if x not in set(got["weekday"])]
    assert len(got["older"]) == 30 and min(got["older"]) == rest[0] and max(got["older"]) == rest[-1]


def test_lasso_meets_its_conditions_and_recovers_a_sparse_line(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = x @ np.array([3.0, 0, 0, -2.0, 0, 0]) + 0.1 * rng.normal(size=40)
    y -= y.mean()
    for penalty, b in zip((1.0, 0.1, 0.01), M.lasso_path(x, y, np.array([1.0, 0.1, 0.01])), strict=True):
        gradient = x.T @ (y - x @ b) / len(x)
        assert np.all(np.abs(gradient) <= penalty + 1e-4) and np.allclose(gradient[b != 0], penalty * np.sign(b[b != 0]), atol=1e-4)
    assert set(np.flatnonzero(M.lasso_path(x, y, np.array([0.2]))[0])) == {0, 3}
    rows = [(f"2026-01-{d:02d}", 100 * d + m, m, float(v), float(w), float(2 * v + 5 * m)) for d in range(1, 29) for m in (0, 1) for v, w in [rng.normal(size=2)]]
    got = M.lasso_by_slot(frame(spark, rows, "day string, id int, slot int, a double, b double, y double"), "day", 20, 20, "slot", ["a", "b"], "y").collect()
    truth = {r[1]: r[5] for r in rows}
    late = [r for r in got if r.id > 2000]
    assert late and np.mean([abs(r.y_pred - truth[r.id]) for r in late]) < 0.5
    assert all(r.alpha > 0 and abs(r.coefficients[0]) > 5 * abs(r.coefficients[1]) for r in late)


def test_boosted_trees_learn_steps(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.uniform(size=(400, 3))
    y = np.where(x[:, 0] > 0.5, 10.0, 0.0) + np.where((x[:, 1] > 0.3) & (x[:, 0] > 0.5), 4.0, 0.0)
    z = rng.uniform(size=(200, 3))
    want = np.where(z[:, 0] > 0.5, 10.0, 0.0) + np.where((z[:, 1] > 0.3) & (z[:, 0] > 0.5), 4.0, 0.0)
    assert np.mean(np.abs(M.boosted(x, y, z, rounds=40) - want)) < 0.6
    assert np.allclose(M.boosted(x[:3], y[:3], z[:2]), y[:3].mean())  # too few rows to split
    rows = [(f"2026-01-{d:02d}", 100 * d + m, m // 4, float(m), 7.0 * (m > 3)) for d in range(1, 20) for m in range(8)]
    df = frame(spark, rows, "day string, id int, block int, m double, y double")
    found = M.boosted_by_fold(df, "day", 14, 50, {"whole": ([], ["m"]), "blocks": (["block"], ["m"])}, "y").collect()
    for name in ("whole", "blocks"):
        got = [r for r in found if r.configuration == name]
        assert got and all(abs(r.y_pred - 7.0 * (r.id % 100 > 3)) < 0.5 for r in got if r.id > 1500)


def test_clusters_of_blobs_are_labelled_from_the_north(spark):
    from quarterlight.operators import clustering as K

    rows = [(i, x + 0.01 * (i % 5), y + 0.01 * (i % 3), 1.0 + i % 2) for i in range(60) for x, y in [((0, 9), (5, 5), (9, 0))[i % 3]]]
    df = spark.createDataFrame(rows, "id long, x double, y double, mw double")
    assert {(r.id % 3, r.cluster) for r in K.kmeans(df, 3).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {(r.id % 3, r.cluster) for r in K.kmeans(df, 3, weight="mw").collect()} == {(0, 0), (1, 1), (2, 2)}
    found = {r.cluster: r for r in K.representatives(df, 3).collect()}
    for k in range(3):
        own = [r for r in rows if r[0] % 3 == k]
        assert found[k].n == 20 and found[k].mw == sum(r[3] for r in own) and found[k].x == pytest.approx(sum(r[1] * r[3] for r in own) / found[k].mw)


def test_cache_finds_what_it_has_and_fetches_the_rest(spark, tmp_path):
    from quarterlight.sources import files

    source = spark.createDataFrame([(k, d, float(10 * d)) for k in "ab" for d in range(4)], "k string, d int, v double")
    asked = []

    def fetch(missing):
        asked.append(sorted(map(tuple, missing.collect())))
        return source.join(missing, ["k", "d"], "left_semi")

    want = lambda *pairs: spark.createDataFrame(list(pairs), "k string, d int")
    path = str(tmp_path / "cache")
    first = files.request(spark, path, want(("a", 0), ("a", 1)), ["k", "d"], fetch).collect()
    again = files.request(spark, path, want(("a", 1), ("b", 2)), ["k", "d"], fetch).collect()
    assert {(r.k, r.d, r.hit) for r in first} == {("a", 0, False), ("a", 1, False)} and {(r.k, r.d, r.hit) for r in again} == {("a", 1, True), ("b", 2, False)}
    assert files.request(spark, path, want(("b", 2)), ["k", "d"], fetch).count() == 1
    assert asked == [[("a", 0), ("a", 1)], [("b", 2)]]


def test_bundle_is_read_back(spark, tmp_path):
    from quarterlight.sources import files

    forecast = spark.createDataFrame([("2024-01", 1.0), ("2024-02", 2.0)], "month string, y double")
    b = files.write_bundle(forecast, spark.createDataFrame([(1, 0.5)], "day int, seconds double"), spark.createDataFrame([("m", 0.25)], "model string, mae double"), {"x": [1, 2]}, str(tmp_path / "b"))
    assert sorted(map(tuple, b["forecast"].select("month", "y").collect())) == [("2024-01", 1.0), ("2024-02", 2.0)]
    assert b["runtime"].first().seconds == 0.5 and b["metrics"].first().mae == 0.25 and b["config"].first().x == [1, 2]
