"""Every registered query runs on the smallest tables and agrees with its oracle."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarterlight.plans import registry

DATA = os.environ.get("QUARTERLIGHT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiub":
            df[c] = df[c].astype("float64").round(6) + 0.0
        else:
            df[c] = df[c].map(lambda x: "" if x is None or x is pd.NaT else str(pd.Timestamp(x)) if hasattr(x, "year") else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = canonical(QUERIES[name](spark, DATA).toPandas()), canonical(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], rtol=1e-12, atol=1e-9, equal_nan=True), c
        else:
            assert got[c].tolist() == want[c].tolist(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_returns_finite_rows(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got) and got.columns.is_unique
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert not np.isinf(got[c]).any(), c


def test_clusters_take_every_unit_of_a_cell_to_its_dominant_area(spark):
    got = QUERIES["D12_kmeans_by_area"](spark, DATA).toPandas()
    mw = got.groupby(["cell_x", "cell_y", "area"]).mw.sum().reset_index().sort_values(["mw", "area"], ascending=[False, True])
    best = mw.drop_duplicates(["cell_x", "cell_y"]).set_index(["cell_x", "cell_y"]).area
    assert all(best[r.cell_x, r.cell_y] == r.cell_area and r.cluster // 3 == r.cell_area for r in got.itertuples())
    assert (got.groupby(["cell_x", "cell_y"]).cluster.nunique() == 1).all()


def test_components_agree_with_a_singular_value_decomposition(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(e.embedding.to_list()).astype(float)
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2]
    got = QUERIES["G15_components"](spark, DATA).orderBy("vec_id").toPandas()
    for k in (0, 1):
        assert np.allclose(got[f"pc{k + 1}"], np.abs(x @ v[k]), atol=2e-3)


def test_rolling_forecast_rows_add_up(spark):
    got = QUERIES["G18_rolling_forecast"](spark, DATA).toPandas()
    for _, own in got.groupby("model"):
        full, days = own[own.fold.isna()].iloc[0], own[own.fold.notna()]
        assert full.n_obs == days.n_obs.sum() and full.mae == pytest.approx((days.mae * days.n_obs).sum() / full.n_obs, abs=1e-5)


def test_one_day_prediction_serves_one_fold(spark):
    got = QUERIES["G23_one_day_prediction"](spark, DATA).toPandas()
    assert got.fold.nunique() == 1 and got.y_pred.notna().all() and got.id.is_unique


def test_bundle_holds_every_day_with_its_measured_time(spark):
    got = QUERIES["G18_forecast_bundle"](spark, DATA).toPandas()
    days = QUERIES["G18_rolling_forecast"](spark, DATA).where("model = 'ridge'").toPandas()
    assert got.timed.all() and got.day.is_unique and set(got.day) == set(days.fold.dropna())
    assert got.rows.sum() == days[days.fold.isna()].n_obs.iloc[0] and got.mae.nunique() == 1 and got.mae.iloc[0] == days[days.fold.isna()].mae.iloc[0]
