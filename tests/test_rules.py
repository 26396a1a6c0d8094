"""Cases that the rules fix, on a few rows each."""

from __future__ import annotations

import json
import statistics

import pytest
from pyspark.sql import functions as F

from stationlake.functions import random as numbers
from stationlake.operators import alerts, besttime, daily, display, forecast, outlook, quality, series, service, states
from stationlake.sources import archive, synthetic
from stationlake.storage import shared_dir

KEYS = ["station_id"]


def slots(spark, columns: dict):
    n = len(next(iter(columns.values())))
    rows = [(0, 900 * i, *(None if v[i] is None else float(v[i]) for v in columns.values())) for i in range(n)]
    return spark.createDataFrame(rows, "station_id int, slot long, " + ", ".join(f"{c} double" for c in columns))


def hits(df):
    return sorted((r["channel"], r["slot"] // 900) for r in df.collect())


def test_stuck_values(spark):
    """A calm night keeps all thermometers still and is no fault; one that stays while another moves is. Zero wind is real."""
    air = ["temp", "temp_b", "temp_c"]
    lengths = {"temp": 8, "temp_b": 8, "temp_c": 8, "rh": 8, "wind": 12}
    calm = slots(spark, {"temp": [18] * 20, "temp_b": [17.8] * 20, "temp_c": [17.9, 18.2] * 10, "rh": list(range(20)), "wind": [0] * 20})
    assert hits(quality.stuck_hits(calm, KEYS, lengths, air)) == []
    moving = slots(spark, {"temp": [18] * 9 + [19] * 11, "temp_b": [18 + i / 5 for i in range(20)], "temp_c": [None] * 20, "rh": [50] * 7 + [None] + [50] * 8 + [51] * 4, "wind": [2] * 12 + [0] * 8})
    got = hits(quality.stuck_hits(moving, KEYS, lengths, air))
    assert got == sorted([("temp", i) for i in range(20)] + [("rh", i) for i in range(8, 16)] + [("wind", i) for i in range(12)])


def test_stuck_values_reach_the_health(spark):
    g = slots(spark, {"temp": [20 + i / 10 for i in range(96)], "rh": [50] * 96, "press": [850 + i / 100 for i in range(96)], "wind": [1 + i / 100 for i in range(96)], "gust": [2 + i / 100 for i in range(96)], "rain": [0] * 96, "n": [1] * 96})
    found = quality.rule_hits(g, KEYS)
    assert {(r["rule"], r["channel"]) for r in found.collect()} == {("R08", "rh")}
    verdicts = quality.channel_days(g, found, KEYS, ["temp", "rh"], F.lit(0)).withColumn("verdict", quality.verdict())
    assert {r["channel"]: r["verdict"] for r in verdicts.collect()} == {"temp": "good", "rh": "bad"}


def test_labels_that_are_missing_stay_missing(spark):
    labels = [0, 0, 0, 0, None, 1, 1, None, 1, 1, 2]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(labels)], "station_id int, slot int, label int")
    got = [r["state"] for r in series.smooth(rows, KEYS, "label").orderBy("slot").collect()]
    assert got == [0, 0, 0, 0, None, 1, 1, None, 1, 1, 1]


def dense_days(spark, values):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "station_id int, day long, mm double")


@pytest.mark.parametrize(
    ("values", "wet", "dry"),
    [([0.0, 2.0, 3.0], 2, 0), ([5.0, 0.0, 0.5, None], 0, 2), ([2.0, None, 4.0, None, None], 1, 0), ([None, None], 0, 0), ([0.2, 0.1], 0, 2), ([1.0], 1, 0)],
)
def test_spells(spark, values, wet, dry):
    r = daily.spells(dense_days(spark, values), KEYS).first()
    assert (r["wet_days"], r["dry_days"]) == (wet, dry)


def test_wettest_days(spark):
    best = lambda v: daily.best_wetting(dense_days(spark, v), KEYS).first()["mm"]
    assert best([10.0, None, 5.0, 1.0]) == 15.0
    assert best([90.0, 90.0, 90.0] + [0.0] * 10) == 0.0
    assert best([90.0, 90.0, 90.0, 1.0] + [0.0] * 6) == 270.0
    assert best([50.0, 50.0]) == 0.0


def test_hours_above_counts_the_threshold(spark):
    g = slots(spark, {"temp": [27, 28, 26.9, None, 27, 30]})
    assert daily.hours_above(g, KEYS, "temp", 27.0).first()["hours"] == 1.0
    assert daily.hours_above(slots(spark, {"temp": [30]}), KEYS, "temp", 27.0).first()["hours"] is None


def test_account_links(spark):
    cases = {
        (1, True, None, None, False): "sign_in",
        (1, False, None, None, False): "sign_in",
        (None, False, 5, None, True): "refuse_unverified",
        (None, True, None, None, False): "create",
        (None, True, 5, 8, True): "refuse_conflict",
        (None, True, 5, None, True): "link",
        (None, True, 5, None, False): "claim",
    }
    df = spark.createDataFrame(list(cases), "known int, verified boolean, owner int, subject int, proven boolean")
    got = [r["a"] for r in df.select(service.link_account(*(F.col(c) for c in ("known", "owner", "verified", "subject", "proven"))).alias("a")).collect()]
    assert got == list(cases.values())


def test_mail_caps(spark):
    sent = spark.createDataFrame([(1, 99_000), (1, 98_000), (2, 96_399), (2, 96_400)], "user_id int, t long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    got = {r["user_id"]: (r["own_last_hour"], r["all_last_hour"], r["cap"]) for r in service.mail_caps(sent, users, "user_id", F.lit(100_000), 2, 10).collect()}
    assert got == {1: (2, 3, "address"), 2: (1, 3, "ok"), 3: (0, 3, "ok")}
    assert {r["cap"] for r in service.mail_caps(sent, users, "user_id", F.lit(100_000), 2, 3).collect()} == {"global"}


def test_best_time_rules_watch_plans(spark):
    rules = spark.createDataFrame([(1, 7, "general"), (2, 7, "farm"), (3, 7, "sport"), (4, 8, "general")], "rule_id int, owner int, activity string")
    impacts = spark.createDataFrame([(7, "farm"), (7, "farm")], "owner int, activity string")
    watched = alerts.watched_impacts(rules, impacts)
    assert {r["rule_id"]: r["impacted"] for r in watched.collect()} == {1: 2, 2: 2, 3: None, 4: None}
    full = watched.selectExpr("*", "0 as station_id", "'best_time' as kind", "0D as offset_c", "cast(null as long) as last")
    for status, want in (("GOOD", {1, 2}), ("POOR", set())):
        stations = spark.createDataFrame([(0, status)], "station_id int, status string").selectExpr("*", "20D as peak", "20D as peak_before", "false as is_hot", "0D as rain_p")
        fired = alerts.evaluate(full, stations, F.lit(1_700_000_000)).filter("fired")
        assert {r["rule_id"] for r in fired.collect()} == want


def test_terms_add_up_to_the_forecast(spark):
    row = spark.createDataFrame([(19.0, 17.5, 22.0)], "x0 double, u0 double, u1 double")
    terms = forecast.seasonal_terms(F.lit(0.4))
    r = row.select(forecast.seasonal(F.lit(0.4)).alias("f"), *(t.alias(n) for n, t in terms.items())).first()
    assert r["f"] == pytest.approx(19.0 + sum(r[n] for n in terms))


def test_quality_levels(spark):
    rows = [(10, 0.0, 0, 0.0), (61, 0.0, 0, 0.0), (181, 0.0, 0, 0.0), (10, 2.5, 0, 0.0), (10, 3.1, 0, 0.0), (10, 0.0, 1, 0.0), (10, 0.0, 3, 0.0), (10, 0.0, 0, 0.26), (10, 0.0, 0, 0.25)]
    df = spark.createDataFrame(rows, "fresh_minutes int, spread double, critical int, filled_share double").selectExpr("*", "20D as temp", "101D as rh")
    got = quality.freshness_quality(df).collect()
    assert [r["quality"] for r in got] == ["GOOD", "DEGRADED", "POOR", "DEGRADED", "POOR", "DEGRADED", "POOR", "DEGRADED", "GOOD"]
    assert all("humidity_out_of_range" in r["flags"] for r in got) and "stale_data" in got[2]["flags"]


def test_escalation(spark):
    q = spark.createDataFrame([(0, "GOOD", 5), (1, "GOOD", 600), (2, "POOR", 600), (3, "GOOD", 5)], "station_id int, quality string, fresh_minutes int")
    bad = spark.createDataFrame([(0, "wind", "bad"), (3, "rain", "bad"), (3, "temp", "suspect")], "station_id int, channel string, verdict string")
    got = {r["station_id"]: (r["quality"], r["health_flags"], r["band_factor"]) for r in outlook.escalate(q, bad, KEYS).collect()}
    assert got == {0: ("DEGRADED", ["station_health_bad:wind"], 1.5), 1: ("POOR", ["forecast_horizon_elapsed"], 1.0), 2: ("POOR", [], 1.0), 3: ("GOOD", [], 1.0)}


def test_rain_chance(spark):
    df = spark.createDataFrame([(80.0, 2.0), (None, 2.0)], "rh double, change double")
    got = [r["p"] for r in df.select(outlook.rain_chance(["rh", "change"], -3.0, [0.03, 0.02], F.lit(0.17)).alias("p")).collect()]
    assert got == [pytest.approx(0.363547, abs=1e-6), 0.17]
    at = spark.range(1).select(*(outlook.valid_for(F.lit(0.4), F.lit(0), F.lit(t)).alias(str(t)) for t in (-1, 0, 10_800, 10_801))).first()
    assert list(at) == [None, 0.4, 0.4, None]


def test_fall_back_to_no_change(spark):
    g = slots(spark, {"temp": [20, 21, 22]})
    fits = spark.createDataFrame([(s, 0.5) for s in range(1, 37)], "step int, a double")
    bands = spark.createDataFrame([(s, b, 1.0, 2.0) for s in range(1, 37) for b in range(8)], "step int, block long, band double, persistence double")
    usual = spark.createDataFrame([(0, 900 * i, 18.0) for i in range(20)], "station_id int, time_of_day long, usual double")
    got = outlook.ahead(g, KEYS, usual, fits, bands).orderBy("step").collect()
    assert len(got) == 37 and (got[0]["value"], got[0]["lower"], got[0]["upper"]) == (22, 22, 22)
    assert (got[1]["kind"], got[1]["value"], got[1]["lower"]) == ("seasonal", 20.0, 19.0)
    assert (got[36]["kind"], got[36]["value"], got[36]["upper"]) == ("no_change", 22.0, 24.0)
    wide = outlook.widen(spark.createDataFrame([(20.0, 19.0, 22.0)], "value double, lower double, upper double"), F.lit(True)).first()
    assert (wide["lower"], wide["upper"]) == (18.5, 23.0)


def test_clean_grid(spark):
    rows = [(0, 0, 1, 20.0, 60.0, None), (0, 0, 2, 21.0, 60.0, None), (0, 900, 3, 99.0, 61.0, 0.2), (0, 2700, 4, 24.0, None, None), (0, 9000, 5, 25.0, 70.0, None)]
    raw = spark.createDataFrame(rows, "station_id int, t long, event_id int, temp double, rh double, rain double").selectExpr("*", "850D as press", "1D as wind")
    got = outlook.clean_grid(raw, KEYS, {"temp": 20.0, "rh": 60.0, "press": 848.0, "wind": 1.0, "rain": 0.0}).orderBy("slot").collect()
    assert [r["temp"] for r in got[:4]] == [21.0, 22.0, 23.0, 24.0] and [r["temp"] for r in got[4:10]] == [24.0] * 6
    assert [r["rain"] for r in got[:3]] == [0.0, 0.2, 0.0] and "temp" in got[1]["imputed"] and "rain" in got[2]["imputed"] and got[0]["imputed"] == []


def test_filled_readings(spark):
    df = spark.createDataFrame([(["temp", "rain"], False), (["wet_bulb", "rain"], True), ([], False)], "imputed array<string>, sparse boolean")
    got = [r["f"] for r in df.select(display.filled_readings(F.col("imputed"), F.col("sparse")).alias("f")).collect()]
    assert got == [["temperature", "wbgt", "rain"], ["wet_bulb", "wbgt"], []]


def plain_numbers(seed, count):
    """The generator step by step with 32-bit words."""
    word, out = 0xFFFFFFFF, []
    for _ in range(count):
        seed = (seed + 0x6D2B79F5) & word
        t = (seed ^ seed >> 15) * (seed | 1) & word
        t ^= t + ((t ^ t >> 7) * (t | 61) & word) & word
        out.append((t ^ t >> 14) / 4294967296)
    return out


def test_numbers_by_their_place(spark):
    for seed in (1, 20260901, 0xFFFFFFFF):
        got = [r["u"] for r in spark.range(1, 200).select(numbers.uniform(F.lit(seed), F.col("id")).alias("u")).collect()]
        assert got == plain_numbers(seed, 199)
    normal = [r["g"] for r in spark.range(4000).select(numbers.gaussian(F.lit(3), F.col("id") * 2 + 1).alias("g")).collect()]
    assert abs(statistics.mean(normal)) < 0.06 and abs(statistics.pstdev(normal) - 1) < 0.05


def test_made_up_series(spark):
    day = synthetic.replay_day(spark, "2026-09-01", 15)
    rows = day.orderBy("t").collect()
    assert len(rows) == 104 and rows[-1]["t"] - rows[0]["t"] == 103 * 900
    assert rows == synthetic.replay_day(spark, "2026-09-01", 15).repartition(7).orderBy("t").collect()
    assert max(r["temp"] for r in rows) > min(r["temp"] for r in rows) + 8


def test_artefacts(spark, tmp_path):
    steps = spark.createDataFrame([(2, 0.5), (1, None)], "step int, a double")
    archive.write_artefact(steps, f"file://{tmp_path}/model")
    text = next(tmp_path.glob("model/*.txt")).read_text()
    assert json.loads(text) == {"steps": [{"step": 1, "a": None}, {"step": 2, "a": 0.5}]}
    assert [r["step"] for r in archive.read_model(spark, f"file://{tmp_path}/model").collect()] == [1, 2]


def test_shared_folder_is_demanded_on_clusters():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(_name, default):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_live_window(spark):
    read = spark.createDataFrame([("a", 0), ("a", 900), ("a", 9000), ("b", 0)], "station_id string, slot long")
    found = {r["station_id"]: r for r in series.live_window(read, ["station_id"], F.lit(9000 + 900 + 600)).collect()}
    assert (found["a"]["silent_minutes"], found["a"]["missing_minutes"], found["a"]["read_slots"], found["a"]["of_slots"]) == (10, 130, 3, 96)
    assert (found["b"]["hours"], found["b"]["silent_minutes"]) == (1, 160)
    ahead = series.live_window(read, ["station_id"], F.lit(9000 + 900 + 240)).filter("station_id = 'a'").first()
    assert ahead["silent_minutes"] == 0 and ahead["missing_minutes"] == 120


def test_waits(spark):
    parts = spark.createDataFrame([("a", 1, 0), ("a", 2, 3600), ("a", 1, 7200), ("a", 2, 9000)], "k string, state int, start long")
    found = {r["state"]: r for r in states.waits(parts, ["k"], least=1).collect()}
    assert (found[1]["next"], found[1]["n"], found[1]["share"], found[1]["hours"]) == (2, 6, 1.0, 0.5)
    assert (found[2]["next"], found[2]["n"], found[2]["hours"]) == (1, 4, 0.625)


def test_windows_by_the_sun(spark):
    points = spark.range(0, 96).select(F.lit("a").alias("k"), (F.col("id") * 900 - 10800).alias("slot"), F.lit(20.0).alias("value"), F.lit(1.0).alias("width"))
    starts = [r["start"] for r in besttime.candidates(points, ["k"], 3600, daylight="sun").collect()]
    assert (min(starts), max(starts)) == (12600, 52200)  # on 1 January the sun is up from about 6:27 to 18:36, three hours ahead of UTC


def test_a_stuck_thermometer_by_the_others(spark):
    """Through ``rule_hits``: stuck while another moves, not in a calm night, not where there is no other one."""
    from stationlake.operators import quality

    def row(i, **patch):
        base = {"temp": 18 + i % 7, "temp_b": 17.7 + i % 7, "temp_c": 17.8 + i % 7, "rh": 50 + i % 9, "press": 850 + i % 5, "wind": 1 + i % 5, "gust": 7, "rain": 0}
        return tuple(float(v) for v in (base | patch).values())

    flat = [row(i, temp=21.5) if 40 <= i < 50 else row(i) for i in range(96)]
    calm = [row(i, temp=15, temp_b=14.7 + i % 4 / 10, temp_c=14.8 + i % 2 / 10) if 8 <= i < 20 else row(i) for i in range(96)]
    names = "temp double, temp_b double, temp_c double, rh double, press double, wind double, gust double, rain double"
    df = spark.createDataFrame([(s, i * 900, 1, *r) for s, rows in ((1, flat), (2, calm)) for i, r in enumerate(rows)], f"station_id int, slot long, n int, {names}")
    hits = quality.rule_hits(df, ["station_id"]).filter("rule = 'R08'").collect()
    assert {(h["station_id"], h["channel"]) for h in hits} == {(1, "temp")} and len(hits) == 10
    assert quality.rule_hits(df.drop("temp_b", "temp_c"), ["station_id"]).filter("rule = 'R08'").count() == 0
