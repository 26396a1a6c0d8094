"""A day replayed, by figures worked out by hand: 18 from 06:00 on, 22 from 12:00 to 15:00, in Nairobi."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stationlake.operators import replay

DAY = 20_000
KEYS = ["k"]


def at(hour: float) -> int:
    return DAY * 86400 + int((hour - 3) * 3600)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(1, at(6 + i / 4), 22.0 if 12 <= 6 + i / 4 < 15 else 18.0) for i in range(72)]
    return spark.createDataFrame(rows, "k int, slot long, value double").withColumn("ok", F.lit(True))


def recorded(series):
    return series.filter("ok").select("k", "slot", F.col("value").alias("recorded"))


def said(spark, frames, value, held=None):
    """Every step of each frame says ``value``."""
    rows = [(1, DAY, a, o, held if held is not None else value, s, o + s * 900, value, value - 1.0, value + 1.0) for a, o in frames for s in range(37)]
    return spark.createDataFrame(rows, "k int, day long, anchor long, observed_at long, held double, step int, target long, value double, lower double, upper double")


def test_frames_of_a_day(spark, series):
    found = replay.frames(series, KEYS, "value", F.col("ok")).filter(f"day = {DAY}").collect()
    assert len(found) == 13 and all(r["available"] and r["observed_at"] == r["anchor"] for r in found)


def test_old_slots_make_no_frame(series):
    gappy = series.withColumn("ok", (F.col("slot") <= at(9)) | (F.col("slot") > at(14.5)))
    found = {r["anchor"]: r["observed_at"] for r in replay.frames(gappy, KEYS, "value", F.col("ok")).filter(f"day = {DAY}").collect()}
    assert [found[at(h)] for h in (9, 10, 12, 13, 14, 15)] == [at(9), at(9), at(9), None, None, at(15)]


def test_checks_against_the_record(spark, series):
    checked = {r["hours"]: r for r in replay.checks(said(spark, [(at(9), at(9))], 20.0, held=19.0), recorded(series), KEYS).collect()}
    assert [checked[h]["recorded"] for h in (1, 3, 6, 9)] == [18, 22, 18, 18]
    assert [checked[h]["error"] for h in (1, 3)] == [2, -2] and [checked[h]["held_error"] for h in (1, 3)] == [1, -3]
    assert checked[9]["target"] == at(18)
    filled = series.withColumn("ok", F.col("slot") != at(10))
    checked = {r["hours"]: r for r in replay.checks(said(spark, [(at(9), at(9))], 20.0), recorded(filled), KEYS).collect()}
    assert checked[1]["recorded"] is None and checked[1]["error"] is None


def test_the_chosen_window_against_noon(spark, series):
    found = replay.window_records(said(spark, [(at(8), at(8))], 20.0), recorded(series), KEYS).first()
    assert (found["best_start"], found["best_peak"]) == (at(8), 18) and (found["noon_start"], found["noon_peak"]) == (at(12), 22)
    gappy = series.withColumn("ok", F.col("slot") != at(12.5))
    assert replay.window_records(said(spark, [(at(8), at(8))], 20.0), recorded(gappy), KEYS).first()["noon_peak"] is None


def test_summary_of_a_day(spark, series):
    both = said(spark, [(at(9), at(9))], 20.0, 19.0).union(said(spark, [(at(10), at(10))], 18.5, 18.0))
    found = {r["hours"]: r for r in replay.summary(replay.checks(both, recorded(series), KEYS), KEYS).collect()}
    assert (found[1]["n"], found[1]["mae"], found[1]["within"]) == (2, 1.25, 0.5)
    assert (found[3]["mae"], found[3]["held_mae"]) == (2.75, 3.5)
    late = replay.summary(replay.checks(said(spark, [(at(20), at(20))], 20.0), recorded(series), KEYS), KEYS).collect()
    assert 9 not in {r["hours"] for r in late}
