"""Streams with late and replayed batches, polygon and line tables, and the whole post-processing chain against plain Python."""

import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterlight.operators import recursive, spatial
from quarterlight.streaming import streams

# --- streams ---


def event_files(spark, folder, batches):
    """One file a batch, read in order of time of writing."""
    schema = "k string, ts timestamp_ntz, v double"
    for i, rows in enumerate(batches):
        path = f"{folder}/{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.startswith("part-"):
                os.utime(f"{path}/{name}", (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def test_windows_drop_late_rows_and_forget_old_windows(spark, tmp_path):
    batches = [[("a", at(10, h), 1.0) for h in range(12)], [("a", at(10, 11, 5), 2.0), ("b", at(10, 11), 5.0), ("a", at(11, 9), 1.0)], [("a", at(2, 3), 100.0), ("a", at(11, 8), 7.0)], [("a", at(11, 12), 1.0)]]
    progress = []
    got = {(r["k"], r["ts"]): (r["v"], r["n"]) for r in streams.windowed_sums(event_stream_of(spark, tmp_path, batches), "k", "v", progress=progress).collect()}
    want = {("a", at(10, h)): (1.0, 1) for h in range(11)} | {("a", at(10, 11)): (3.0, 2), ("b", at(10, 11)): (5.0, 1), ("a", at(11, 9)): (1.0, 1), ("a", at(11, 8)): (7.0, 1), ("a", at(11, 12)): (1.0, 1)}
    assert got == want  # the row of the 2nd came nine days late
    state = [p["stateOperators"][0] for p in progress]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    assert max(s["numRowsTotal"] for s in state) >= 12 and state[-1]["numRowsTotal"] <= 4


def event_stream_of(spark, tmp_path, batches):
    return event_files(spark, str(tmp_path / "in"), batches)


def test_days_close_by_timer_and_drop_late_rows(spark, tmp_path):
    quarter = [at(10, 0) + dt.timedelta(minutes=15 * i) for i in range(96)]
    # Local days are an hour ahead: the last four quarter-hours belong to the next one.
    batches = [[("a", t, 1.0) for t in quarter[:50]], [("a", t, 1.0) for t in quarter[40:]], [("a", at(14, 5), 1.0)], [("a", at(10, 1), 1.0), ("a", at(14, 5), 1.0)], [("a", at(14, 6), 1.0)]]
    progress = []
    got = {r["day"]: (r["n"], r["complete"], r["closed"]) for r in streams.day_completeness(event_stream_of(spark, tmp_path, batches), progress=progress).collect()}
    assert got == {dt.date(2024, 1, 10): (92, False, True), dt.date(2024, 1, 11): (4, False, True), dt.date(2024, 1, 14): (2, False, False)}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_upsert_rewrites_only_touched_days_and_replays(spark, tmp_path):
    base = str(tmp_path / "table")
    table = streams.DayTable(spark, ["k", "ts"], "v", base)
    frame = lambda rows: spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    size = lambda batch: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(f"{base}/data/batch={batch}") for f in names if f.endswith(".parquet"))
    big = [(f"k{i}", at(d, 5), float(i)) for d in range(1, 9) for i in range(300)]
    table.upsert(frame(big), F.to_date("ts"), 0)
    table.upsert(frame([("k1", at(3, 5), 1000.0), ("k2", at(3, 5), -1.0), ("new", at(3, 6), 1.0), ("none", None, 2.0)]), F.to_date("ts"), 1)
    assert size(1) < size(0) / 4 and table.versions() == {f"2024-01-0{d}": int(d == 3) for d in range(1, 9)} | {"none": 1}
    rows = {(r["k"], r["ts"]): r["v"] for r in table.read("k string, ts timestamp_ntz, v double").collect()}
    assert len(rows) == 2402 and rows["k1", at(3, 5)] == 1000.0 and rows["k2", at(3, 5)] == 2.0 and rows["none", None] == 2.0
    table.upsert(frame([("k1", at(4, 5), 9000.0)]), F.to_date("ts"), 2)
    before = sorted(map(tuple, table.read("").collect()), key=str)
    for batch, again in ((1, [("k1", at(3, 5), 1000.0), ("k2", at(3, 5), -1.0), ("new", at(3, 6), 1.0), ("none", None, 2.0)]), (2, [("k1", at(4, 5), 9000.0)])):
        table.upsert(frame(again), F.to_date("ts"), batch)
    assert sorted(map(tuple, table.read("").collect()), key=str) == before
    assert streams.DayTable(spark, ["k"], "v", str(tmp_path / "nothing")).read("k string, v double").count() == 0


# --- polygons and lines ---


def inside(px, py, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2 and min(y1, y2) <= py < max(y1, y2) and px < x1 + (py - y1) * ((x2 - x1) / (y2 - y1)):
            hit = not hit
    return hit


@pytest.mark.parametrize("size", [0.07, 0.5, 3.0])
def test_points_in_hundreds_of_polygons(spark, size):
    rng = random.Random(7)
    rings = {}
    for k in range(300):
        cx, cy, n = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randint(3, 9)
        rings[k] = [(cx + (r := rng.uniform(0.02, 0.6)) * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n)]  # mostly not convex
    rings[900] = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]  # level edges on cell borders
    rings[901] = [(-2.5, -2.5), (2.5, -2.5), (2.5, 2.5), (0.0, -2.0), (-2.5, 2.5)]
    points = [(i, rng.uniform(-3.2, 3.2), rng.uniform(-3.2, 3.2)) for i in range(400)] + [(1000 + i, x, y) for i, (x, y) in enumerate([(-1.0, -1.0), (1.0, 1.0), (0.0, 1.0), (-1.0, 0.0), (0.5, 0.5), (0.0, -2.0)])] + [(2000, None, 1.0)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    r = spark.createDataFrame([(k, [{"x": a, "y": b} for a, b in v]) for k, v in rings.items()] + [(902, []), (903, [{"x": None, "y": 1.0}])], "polygon long, ring array<struct<x:double,y:double>>")
    got = sorted((a["id"], a["polygon"]) for a in spatial.points_in_polygons(p, r, size).collect())
    want = sorted((i, k) for i, x, y in points if x is not None for k, ring in rings.items() if inside(x, y, ring))
    assert got == want and len(want) > 300


def test_distances_to_lines_in_reach(spark):
    rng = random.Random(1)
    segments = [(k % 12, x := rng.uniform(5, 8), y := rng.uniform(50, 53), x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for k in range(60)] + [(99, 6.0, 51.0, 6.0, 51.0)]
    points = [(i, rng.uniform(5, 8), rng.uniform(50, 53)) for i in range(150)]
    want = {}
    for i, x, y in points:
        for line, x1, y1, x2, y2 in segments:
            kx, ky = math.cos(math.radians(y)) * 111.32, 110.574
            ax, ay, dx, dy = (x1 - x) * kx, (y1 - y) * ky, (x2 - x1) * kx, (y2 - y1) * ky
            t = max(0, min(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0
            ex, ey = ax + t * dx, ay + t * dy
            if abs(ex) <= 0.25 * kx and abs(ey) <= 0.25 * ky:
                want[i, line] = min(want.get((i, line), 1e9), math.hypot(ex, ey))
    got = {(r["id"], r["line"]): r["km"] for r in spatial.lines_distance_km(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(segments, "line long, x1 double, y1 double, x2 double, y2 double"), 0.25).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 100


# --- the whole post-processing chain ---


def label(group, row, edges, pred):
    if group == "global":
        return ()
    return tuple(sum(e < pred for e in edges) if part == "bin" else row[part] for part in group.split("_"))


def plain_chain(rows, how):
    """The chain for one series as a loop over days and rows; only numpy's quantile and solve."""
    done, out = [], []
    edges_of = lambda h: sorted(set(np.quantile([r["p"] for r in h], [k / how.bins for k in range(1, how.bins)]).tolist())) if h else []
    past = lambda day, window: [r for r in done if day - dt.timedelta(window) <= r["day"] <= day - dt.timedelta(how.lag) and r["true"] is not None]
    for day in sorted({r["day"] for r in rows}):
        today = [dict(r, p=r["base"], q=None) for r in rows if r["day"] == day]
        h = past(day, how.window)
        if len(h) >= how.least and how.group != "none":
            edges, by = edges_of(h), {}
            for r in h:
                by.setdefault(label(how.group, r, edges, r["p"]), []).append(r["p"] - r["true"])
            every = np.mean([r["p"] - r["true"] for r in h])
            for r in today:
                e = by.get(label(how.group, r, edges, r["p"]), [])
                r["p"] = min(max(r["p"] - how.shrinkage * (np.mean(e) if len(e) >= how.least else every), 0), how.top)
        h = past(day, how.calibrator_window)
        if len(h) >= how.calibrator_least:
            x = lambda rows: np.array([[r["p"], math.sin(math.pi * r["hour"] / 12), math.cos(math.pi * r["hour"] / 12), r["kind"]] for r in rows])
            a, y = x(h), np.array([r["true"] - r["p"] for r in h])
            mean, std = a.mean(axis=0), a.std(axis=0)
            std = np.where(std < 1e-9, 1, std)
            a = (a - mean) / std
            beta = np.linalg.solve(a.T @ a + how.alpha * np.eye(4), a.T @ (y - y.mean()))
            for r, fix in zip(today, (x(today) - mean) / std @ beta + y.mean()):
                r["p"] = min(max(r["p"] + how.blend * fix, 0), how.top)
        h = past(day, how.quantile_window)
        if len(h) >= how.quantile_least:
            edges = edges_of(h)
            for r in today:
                mine = [k["true"] - k["p"] for k in h if label(how.quantile_group, k, edges, k["p"]) == label(how.quantile_group, r, edges, r["p"])]
                mine = mine if len(mine) >= how.quantile_least else [k["true"] - k["p"] for k in h]
                m, top = np.quantile(mine, 0.5), 0.0
                r["q"] = [top := max(top, min(max(r["p"] + m + how.spread * (v - m), 0), how.top)) for v in np.quantile(mine, how.taus)]
        done += today
        out += today
    return {r["ts"]: (r["base"], r["p"], r["q"]) for r in out}


@pytest.mark.parametrize("group, quantile_group", [("kind_bin", "hour"), ("global", "bin"), ("hour_bin", "kind_hour"), ("none", "mtu"), ("bin", "kind_mtu")])
def test_chain_equals_a_loop_over_days(spark, group, quantile_group):
    rng = np.random.default_rng(4)
    rows = {"x": [], "y": []}
    for name, own in rows.items():
        for d in range(16):
            if d == 6 and name == "y":
                continue
            for i in range(0, 96, 4 if name == "x" else 7):
                base = float(rng.uniform(0, 80))
                ts = dt.datetime(2024, 2, 1) + dt.timedelta(days=d, minutes=15 * i)
                own.append({"ts": ts, "day": ts.date(), "hour": i // 4, "mtu": i, "kind": int(ts.weekday() >= 5), "base": base, "true": None if rng.random() < 0.1 else 0.8 * base + 4 + float(rng.normal())})
    how = recursive.Postprocess(lag=1, group=group, quantile_group=quantile_group, window=6, least=5, calibrator_window=8, calibrator_least=40, quantile_window=5, quantile_least=4, spread=1.2, top=75.0)
    df = spark.createDataFrame([(n, *[r[c] for c in ("ts", "day", "hour", "mtu", "kind", "base", "true")]) for n, own in rows.items() for r in own], "model string, ts timestamp_ntz, day date, hour int, mtu int, kind int, y_pred double, y_true double")
    got = recursive.postprocess_days(df, ["model"], how)
    want = {name: plain_chain(own, how) for name, own in rows.items()}
    for r in got.collect():
        base, p, q = want[r["model"]][r["ts"]]
        assert r["y_base"] == base and abs(r["y_pred"] - p) < 1e-7
        assert (r["quantiles"] is None) == (q is None) and (q is None or np.allclose(r["quantiles"], q, atol=1e-7))
    totals = {r["ts"]: r["y_pred"] for r in recursive.component_totals(got, "model", "total", 2).collect()}
    x, y = want["x"], want["y"]
    assert totals.keys() == x.keys() & y.keys() and all(abs(v - x[t][1] - y[t][1]) < 1e-7 for t, v in totals.items())
