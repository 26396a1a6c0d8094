"""Raw rows to gridded observations: figures worked out by hand."""

from __future__ import annotations

import pytest

from stationlake.operators import observations

T0 = 1_788_253_200  # a full hour, after the rain day began
BASE = {"temp": 20.0, "rh": 60.0, "press": 851.0, "wind": 1.0, "wind_dir": 90.0, "gust": 2.0, "vis": 300.0, "wet_bulb": 15.0, "total": 0.0, "prior": 0.0, "rain": None}
FIELDS = ", ".join(f"{c} double" for c in BASE)
NOTHING = dict.fromkeys(BASE)
SCENARIOS = {
    "missing_rain_is_marked": ([{"m": 0}, {"m": 15, "total": None}, {"m": 30}], "counters", ()),
    "rain_is_the_rise_of_the_total": ([*({"m": i * 15 + 3, "total": t} for i, t in enumerate([0, 0, 0.4, 1.0, 1.0]))], "counters", ()),
    "a_gap_keeps_its_rain_on_the_reading_after_it": ([{"m": 0, "total": 1.0}, {"m": 15, "total": 1.0}, {"m": 195, "total": 4.0}], "counters", ()),
    "totals_are_carried_unmarked": ([{"m": 0, "total": None}, {"m": 15, "total": 1.4}, {"m": 60, "total": None}, {"m": 75, "total": 1.6}], "counters", ()),
    "reported_sums": ([{**NOTHING, "m": 0, "temp": 20.0, "rain": 1.5}, {**NOTHING, "m": 15, "temp": 20.0}, {**NOTHING, "m": 45, "temp": 21.0}], "sums", ()),
    "highest_gust_and_mean_direction": ([{"m": 1, "gust": 3.0, "wind_dir": 350.0}, {"m": 9, "gust": 5.5, "wind_dir": 10.0}, {"m": 16, "gust": 2.0, "wind_dir": 90.0}], "counters", ()),
    "direction_is_filled_the_short_way_round": ([{"m": 0, "wind_dir": 350.0}, {"m": 45, "wind_dir": 20.0}], "counters", ()),
    "drift_leaves_empty_slots_but_no_missing_time": ([*({"m": 0, "s": i * 906} for i in range(300))], "counters", ()),
    "silence_counts_from_an_interval_after_the_reading": ([{"m": 0}, {"m": 15}, {"m": 75}, {"m": 90}], "counters", ()),
    "late_readings_open_no_silence": ([*({"m": m} for m in (0, 1, 2, 3, 6, 7, 8))], "counters", ()),
    "an_impossible_reading_goes_with_what_was_made_of_it": ([{"m": 0, "temp": 20.0}, {"m": 15, "temp": 85.0, "wet_bulb": 40.0}, {"m": 30, "temp": 22.0}], "counters", ()),
    "faults_stand_ins_and_floors": ([{"m": 0, "gust": 0.5, "vis": -3.0, "wet_bulb": None}, {"m": 60, "gust": None, "wet_bulb": None}, {"m": 120, "gust": None, "wet_bulb": None}], "counters", ()),
    "repeats_and_missing_channels": ([{"m": 0, "temp": 10.0}, {"m": 0, "temp": 30.0}, {"m": 15}], "counters", ("gust", "wind_dir", "vis", "wet_bulb", "prior")),
}


@pytest.fixture(scope="module")
def grids(spark):
    """All scenarios at once, a station each, for each form of rain and set of channels."""
    found = {}
    for form in {s[1:] for s in SCENARIOS.values()}:
        rain, drop = form
        names = [n for n, s in SCENARIOS.items() if s[1:] == form]
        table = []
        for station, name in enumerate(names):
            for n, r in enumerate(SCENARIOS[name][0]):
                values = [None if (v := {**BASE, **r}[c]) is None else float(v) for c in BASE]
                table.append((station, T0 + int(r.get("s", r["m"] * 60)), n, *values))
        df = spark.createDataFrame(table, f"station_id int, t long, event_id long, {FIELDS}").drop(*drop)
        df = df.drop("rain") if rain == "counters" else df.drop("total", "prior")
        rows = observations.observation_grid(df, ["station_id"], rain).orderBy("slot").collect()
        found |= {name: [r for r in rows if r["station_id"] == station] for station, name in enumerate(names)}
    return found


def test_missing_rain_is_marked(grids):
    found = grids["missing_rain_is_marked"]
    assert found[1]["rain"] == 0 and "rain" in found[1]["imputed"] and "rain" not in found[2]["imputed"]


def test_rain_is_the_rise_of_the_total(grids):
    found = grids["rain_is_the_rise_of_the_total"]
    assert "rain" in found[0]["imputed"] and [r["rain"] for r in found] == pytest.approx([0, 0, 0.4, 0.6, 0])


def test_a_gap_keeps_its_rain_on_the_reading_after_it(grids):
    found = grids["a_gap_keeps_its_rain_on_the_reading_after_it"]
    assert all("rain" in r["imputed"] for r in found[2:-1]) and found[-1]["rain"] == 3.0


def test_totals_are_carried_unmarked(grids):
    found = grids["totals_are_carried_unmarked"]
    assert [r["total"] for r in found] == [0, 1.4, 1.4, 1.4, 1.4, 1.6]
    assert not any("total" in r["imputed"] for r in found)


def test_reported_sums(grids):
    found = grids["reported_sums"]
    assert [r["rain"] for r in found] == [1.5, 0, 0, 0]
    assert "rain" not in found[1]["imputed"] and "rain" in found[2]["imputed"]


def test_highest_gust_and_mean_direction(grids):
    found = grids["highest_gust_and_mean_direction"]
    assert found[0]["gust"] == 5.5 and found[0]["wind_dir"] == 0


def test_direction_is_filled_the_short_way_round(grids):
    found = grids["direction_is_filled_the_short_way_round"]
    assert [round(r["wind_dir"]) % 360 for r in found] == [350, 0, 10, 20]


def test_drift_leaves_empty_slots_but_no_missing_time(grids):
    found = grids["drift_leaves_empty_slots_but_no_missing_time"]
    assert any("temp" in r["imputed"] for r in found) and not any(r["gap_minutes"] for r in found)


def test_silence_counts_from_an_interval_after_the_reading(grids):
    found = grids["silence_counts_from_an_interval_after_the_reading"]
    assert sum(r["gap_minutes"] for r in found) == 45
    first = next(r for r in found if r["gap_minutes"])
    assert first["slot"] == T0 + 1800 and (first["gap"]["from"], first["gap"]["to"]) == (T0 + 900, T0 + 4500)


def test_late_readings_open_no_silence(grids):
    found = grids["late_readings_open_no_silence"]
    assert [r["late_intervals"] for r in found] == [1] and found[0]["gap_minutes"] == 0


def test_an_impossible_reading_goes_with_what_was_made_of_it(grids):
    found = grids["an_impossible_reading_goes_with_what_was_made_of_it"]
    assert found[1]["temp"] == 21 and found[1]["rejected"] == ["temp"] and found[0]["rejected"] == []
    assert {"temp", "wet_bulb"} <= set(found[1]["imputed"])


def test_faults_stand_ins_and_floors(grids):
    found = grids["faults_stand_ins_and_floors"]
    assert found[0]["raw_faults"] == ["wind_gust"] and found[0]["vis"] == 0 and found[0]["uv"] == 0
    assert found[-1]["gust"] == found[-1]["wind"] and "gust" in found[-1]["imputed"]
    assert found[0]["wet_bulb"] == pytest.approx(15.05, abs=0.1) and "wet_bulb" not in found[0]["imputed"]


def test_repeats_and_missing_channels(grids):
    found = grids["repeats_and_missing_channels"]
    assert found[0]["temp"] == 30 and "gust" not in found[0].asDict()
