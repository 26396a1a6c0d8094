"""Steps that must not grow faster than their input, and their results against plain ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stationlake import plans
from stationlake.operators import besttime, fitting, joins, outlook


def shown(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def requests_and_windows(spark):
    rng = random.Random(6)
    windows = [(s, d, d * 86400 + h * 900, d * 86400 + h * 900 + 7200, rng.randrange(3), rng.random(), rng.random(), rng.random()) for s in (0, 1) for d in (1, 2) for h in range(0, 80, 3)]
    asked = [(i, rng.randrange(3), d := rng.randrange(1, 4), (b := d * 86400 + rng.randrange(80) * 900), b + rng.randrange(0, 60) * 900, d * 86400 + rng.randrange(90) * 900) for i in range(300)]
    w = spark.createDataFrame(windows, "station_id long, day long, start long, end long, rank int, peak double, width double, mean double")
    return asked, windows, spark.createDataFrame(asked, "request_id long, station_id long, day long, window_start long, window_end long, now long"), w


@pytest.mark.parametrize("reasons", [False, True])
def test_plans_pair_no_request_with_windows(spark, reasons):
    asked, windows, requests, w = requests_and_windows(spark)
    quality = spark.createDataFrame([(0, "GOOD"), (1, "POOR"), (2, "GOOD")], "station_id long, quality string")
    own, region, keys, more = w.filter("day = 1"), w.filter("station_id = 1"), ["station_id", "day"], ()
    if reasons:
        more = (7200, (12600, 56100))
    found = (outlook.plan_with_reasons if reasons else outlook.plan)(requests, own, region, quality, keys, besttime.order(), *more)
    assert "Aggregate [request_id" not in shown(found)

    def best(i, s, d, begin, end, of):
        fit = [x for x in of if x[:2] == (s, d) and x[2] >= begin and x[3] <= end]
        return min(fit, key=lambda x: (x[4], x[5] // 0.05, x[6] // 0.1, x[7], x[2]))[2] if fit else None

    starts = {r["request_id"]: r["start"] for r in found.collect()}
    assert len(starts) == len(asked) and any(starts.values())
    for i, s, d, begin, end, now in asked:
        begin = max(begin, now) if reasons else begin
        station = best(i, s, d, begin, end, [x for x in windows if x[1] == 1]) if s != 1 else None
        regional = [(*x[:6], 4.0, x[7]) if reasons else x for x in windows if x[0] == 1]
        assert starts[i] == (station if station is not None else best(i, s, d, begin, end, regional))


def test_lookback_counts_once_for_each_end(spark):
    """Anchors between slots, ahead of the first, after the last, in a hole, and one that is there twice."""
    slots = [900 * i for i in range(40) if i not in (10, 11, 12, 30)]
    anchors = [(1, -500), (2, 5 * 900 + 1), (3, 12 * 900), (4, 31 * 900 + 899), (5, 10**6), (5, 10**6), (6, 0), (7, -5000), (8, 39 * 900)]
    grid = spark.createDataFrame([(0, s) for s in slots], "station_id int, slot long")
    df = outlook.lookback(spark.createDataFrame([(0, *a) for a in anchors], "station_id int, anchor_id int, anchor long"), grid, ["station_id"], hours=2, least_rows=3, reach=1000)
    want = []
    for k, a in anchors:
        end = min(a - a % 900, 39 * 900)
        n = sum(end - 7200 < s <= end for s in slots)
        if a >= -1000 and n >= 3:
            want.append((k, end, a > 39 * 900, n))
    assert sorted((r["anchor_id"], r["end"], r["realtime"], r["rows"]) for r in df.collect()) == sorted(want)
    assert "Aggregate [station_id, anchor_id" not in shown(df)


@pytest.mark.parametrize("tolerance", [0, 900, 200_000])
def test_nearest_makes_no_pairs(spark, tolerance):
    """Rows on both sides of a day's end, at the same time, without a key or time, and values that aren't known."""
    rng = random.Random(tolerance)
    some = lambda n, step: [(rng.choice([0, 1, None]), rng.choice([None, rng.randrange(0, 4 * 86400, step)])) for _ in range(n)]
    left, right = some(300, 60), {x: rng.choice([None, rng.random()]) for x in some(200, 60)}
    l = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "id int, k int, t long")  # noqa: E741
    r = spark.createDataFrame([(*x, v) for x, v in right.items()], "k int, rt long, v double")
    df = joins.nearest(l, r, ["k"], tolerance, "t", "rt", "v")
    assert "Join" not in shown(df)
    found = {x["id"]: x["v"] for x in df.collect()}
    assert len(found) == len(left)
    for i, (k, t) in enumerate(left):
        near = [(abs(t - rt), rt, v) for (rk, rt), v in right.items() if rt is not None and rk == k is not None and abs(t - rt) <= tolerance] if t is not None and k is not None else []
        assert found[i] == (min(near, key=lambda x: x[:2])[2] if near else None)


def test_clusters_take_equal_rows_once(spark, monkeypatch):
    seen = []

    class Counting(fitting.KMeans):
        def fit(self, rows):
            seen.append(rows.count())
            return super().fit(rows)

    monkeypatch.setattr(fitting, "KMeans", Counting)
    points = [(0.0, 0.0)] * 300 + [(1.0, 0.0)] * 100 + [(10.0, 0.0)] * 7 + [(20.0, 5.0)] * 9 + [(30.0, -5.0)] * 50
    found = fitting.clusters(spark.createDataFrame(points, "x double, y double").repartition(7), ["x", "y"])
    assert seen == [5, 5, 5]
    assert [c for row in found for c in row] == pytest.approx([0.25, 0.0, 10.0, 0.0, 20.0, 5.0, 30.0, -5.0])


def test_rows_of_the_named_queries(spark, sf_dir):
    for name in ("activity_plan", "activity_plan_reasons"):
        assert "Aggregate [request_id" not in shown(plans.QUERIES[name](spark, sf_dir)), name
    assert plans.QUERIES["nearest_within_tol"](spark, sf_dir).filter(F.col("temp").isNotNull()).count() > 0
