from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stationlake.operators import besttime, counters, farm, series, spatial


def smooth(spark, labels):
    rows = spark.createDataFrame([(1, i * 900, x) for i, x in enumerate(labels)], "station_id int, slot long, label int")
    done = series.smooth(rows, ["station_id"], "label")
    return done, [r["state"] for r in done.orderBy("slot").collect()]


def test_smoothing_golden(spark):
    done, states = smooth(spark, [None, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 2, 1, 1, 3, 3, 3])
    assert states == [None] + [0] * 9 + [1] * 11
    parts = series.segments(done, ["station_id"], "state").orderBy("start").collect()
    assert [(r["state"], r["start"] // 900, r["end"] // 900) for r in parts] == [(0, 1, 10), (1, 10, 21)]


@pytest.mark.parametrize("labels", [[2, 3, 3, 3, 3, 3], [2, 3, 2, 3]])
def test_smoothing_of_short_series(spark, labels):
    assert smooth(spark, labels)[1] == [3] * len(labels)


DAY = 86400
SIX = 1_700_000_000 // DAY * DAY + 21600


def counted(readings):
    return [mm for mm, _ in counters.fold(readings)]


def test_counter_golden(spark):
    totals = [0, 0, 0.4, 1.0, 1.0]
    rows = [(1, SIX + i * 900, float(x), None) for i, x in enumerate(totals)]
    df = spark.createDataFrame(rows, "station_id long, t long, total double, prior double")
    assert [r["mm"] for r in counters.counter_rain(df, ["station_id"]).orderBy("t").collect()] == [None, 0, 0.4, 0.6, 0]


def test_counter_restarts_and_dips():
    assert counted([(SIX, 1.0, None), (SIX + 900, 0.5, None), (SIX + 1800, 1.2, None)]) == [None, 0, 0.2]
    assert counted([(SIX, 5.0, None), (SIX + DAY, 0.4, 5.6)]) == [None, 1.0]
    assert counted([(SIX, 5.0, None), (SIX + DAY, 5.2, None), (SIX + DAY + 900, 0.4, None)]) == [None, 0.2, 0.4]
    assert counted([(SIX, 5.0, None), (SIX + 2 * DAY, 7.0, None)]) == [None, 7.0]
    assert counted([(SIX, 5.0, None), (SIX + 900, None, None), (SIX + 1800, 5.5, None)]) == [None, None, 0.5]


def test_counter_is_never_negative():
    rng = random.Random(1)
    rows = [(SIX + i * 3600, round(rng.random() * 10, 1) if rng.random() > 0.1 else None, None) for i in range(500)]
    assert all(mm is None or mm >= 0 for mm in counted(rows))


def test_tolerant_ranking():
    window = lambda start, rank, peak, width, mean, **more: {"start": start, "end": start + 2, "rank": rank, "peak": peak, "width": width, "mean": mean} | more
    rows = [window(0, 1, 19.0, 1.0, 18.0), window(1, 0, 17.9, 1.0, 17.0), window(2, 0, 17.88, 0.5, 17.5), window(5, 0, 17.5, 2.0, 17.4)]
    best, other = besttime.rank_with_tolerances(rows)
    assert (best["start"], other["start"]) == (5, 2)
    assert besttime.rank_with_tolerances(rows[:1])[1] is None
    wet = [window(0, 0, 17.0, 1.0, 16.0, rain=0.5), window(5, 0, 17.01, 1.0, 16.5, rain=0.1)]
    assert besttime.rank_with_tolerances(wet)[0]["start"] == 5
    assert besttime.rank_with_tolerances([wet[0], wet[1] | {"rain": None}])[0]["start"] == 0


def test_windows_have_no_holes(spark):
    slots = [0, 900, 1800, 3600, 4500]
    f = spark.createDataFrame([(1, s, 20.0 + s / 900, 1.0) for s in slots], "station_id int, slot long, value double, width double")
    got = besttime.candidates(f, ["station_id"], 1800).orderBy("start").collect()
    assert [(r["start"], r["peak"]) for r in got] == [(0, 21.0), (900, 22.0), (3600, 25.0)]


def test_summary_golden(spark):
    def run(values):
        s = spark.createDataFrame([("a", v, 1.0) for v in values], "area string, value double, weight double")
        return spatial.summary(s, ["area"]).first()

    whole = run([18.0, 20.0, 22.0, 24.0, None])
    assert (whole["mean"], whole["min"], whole["max"], whole["above_pct"], whole["coverage_pct"]) == (21, 18, 24, 50, 80)
    thin = run([18.0, 20.0, 22.0, None, None])
    assert thin["mean"] is None and thin["above_pct"] is None and thin["coverage_pct"] == 60


def test_areas_with_holes(spark):
    square, hole = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]]
    areas = spark.createDataFrame([("a", [[square, hole]])], "area string, polygons array<array<array<array<double>>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 5.0, 1.0), (4, 3.5, 2.0)], "p int, lng double, lat double")
    assert sorted(r["p"] for r in spatial.locate(points, areas).collect()) == [1, 4]
    samples = spatial.sample_area(areas, 8).collect()
    assert len(samples) == 48 and all(not (1 < r["lng"] < 3 and 1 < r["lat"] < 3) for r in samples)


def test_balance_is_clamped_at_each_step(spark):
    days = spark.createDataFrame([(1, d, n) for d, n in enumerate([5.0, 50.0, -200.0, 7.0])], "station_id int, day long, net double")
    got = farm.clamped_balance(days.orderBy(F.desc("day")), ["station_id"], "net", F.lit(40.0)).first()
    assert got["depletion"] == 7.0


@pytest.mark.parametrize(
    "depletion,raw,rain,dries,known,want",
    [
        (10, 20, None, False, True, ("NO_IRRIGATION", 0, 0, 2)),
        (33, 20, None, False, True, ("IRRIGATE_NOW", 20, 10, None)),
        (33, 40, 0.0, False, False, ("DATA_TOO_THIN", 0, 0, None)),
        (33, 20, 40.0, False, True, ("HOLD_RAIN_EXPECTED", 0, 0, None)),
        (33, 20, 10.0, False, True, ("IRRIGATE_NOW", 20, 5, None)),
        (33, 20, None, True, True, ("NO_IRRIGATION", 0, 0, None)),
        (4, 3, None, False, True, ("NO_IRRIGATION", 0, 0, None)),
    ],
)
def test_irrigation_decisions(spark, depletion, raw, rain, dries, known, want):
    d = lambda x: F.lit(x).cast("double")
    advice = farm.irrigation_advice(d(depletion), d(raw), d(5.0), d(rain), F.lit(dries), F.lit(known))
    got = spark.range(1).select(advice.alias("a")).select("a.*").first()
    assert tuple(got) == want


def test_counter_days_equal_the_fold(spark):
    """Three counters of uneven days: restarts late, missed, twice and never, dips, silent days, unknown totals."""
    import random

    draw, table = random.Random(4), []
    for counter in range(12):
        t, total, rows = 1_700_000_000, 0.0, []
        for _ in range(150):
            t += draw.choice([900, 3600, 20_000, 40_000, 90_000, 200_000])
            total = draw.choice([0.0, total - 0.05, total - 0.3, total, total + 0.2, total + 3.0, total / 2])
            rows.append((t, draw.choice([total, total, total, None, float("nan")]), draw.choice([None, total, total + 1])))
        table += [(counter, *r) for r in rows]
    df = spark.createDataFrame(table, "station_id int, t long, total double, prior double").repartition(3)
    found = {(r["station_id"], r["t"]): r["mm"] for r in counters.counter_rain(df, ["station_id"]).collect()}
    for counter in range(12):
        own = [r[1:] for r in table if r[0] == counter]
        want = [mm for mm, _ in counters.fold(own)]
        assert [found[counter, r[0]] for r in own] == want
    assert counters.counter_rain(df.limit(0), ["station_id"]).count() == 0
