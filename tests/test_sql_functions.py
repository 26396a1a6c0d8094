"""SQL functions against the Columns that they stand for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stationlake.functions import agro, heat, sql

COLUMNS = {
    "stull_wet_bulb(a, b)": lambda a, b: heat.stull_wet_bulb(a, b),
    "shade_wbgt(a, b)": lambda a, b: heat.shade_wbgt(a, b),
    "shade_wbgt_rh(a, b)": lambda a, b: heat.shade_wbgt(a, heat.stull_wet_bulb(a, b)),
    "dew_point(a, b)": lambda a, b: heat.dew_point(a, b),
    "heat_index(a, b)": lambda a, b: heat.heat_index(a, b),
    "risk_band(a)": lambda a, b: heat.risk_band(a),
    "risk_band(a, b / 20)": lambda a, b: heat.risk_band(a, b / 20),
    "risk_rank(risk_band(a))": lambda a, b: heat.risk_rank(heat.risk_band(a)),
    "uncertainty(a / 10)": lambda a, b: heat.uncertainty(a / 10),
    "extraterrestrial_radiation_mm(cast(b as int))": lambda a, b: agro.extraterrestrial_radiation_mm(b.cast("int")),
    "et0_hargreaves(a + 6, a - 6, cast(b as int))": lambda a, b: agro.et0_hargreaves(a + 6, a - 6, b.cast("int")),
    "effective_rain(a)": lambda a, b: agro.effective_rain(a),
    "depletion_fraction(0.5D, b / 10)": lambda a, b: agro.depletion_fraction(F.lit(0.5), b / 10),
    "floor_to_five(a)": lambda a, b: agro.floor_to_five(a),
    "flood_risk(a, b / 200)": lambda a, b: heat.flood_risk(a, b / 200),
}


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark)
    values = [(float(t), float(rh)) for t in (-3, 0, 12.5, 17.9, 18, 21, 24, 31, 38, 43) for rh in (1, 7, 12, 40, 60, 86, 95, 99)] + [(None, 50.0), (20.0, None), (None, None)]
    return spark.createDataFrame(values, "a double, b double")


@pytest.mark.parametrize("call", COLUMNS)
def test_equals_the_column(rows, call):
    found = rows.select(F.expr(call).alias("x"), COLUMNS[call](F.col("a"), F.col("b")).alias("y")).collect()
    assert all(r["x"] == (pytest.approx(r["y"], abs=1e-9) if isinstance(r["y"], float) else r["y"]) for r in found)


def test_no_python_in_the_plan(spark, rows):
    rows.createOrReplaceTempView("air_rows")
    plan = spark.sql("SELECT heat_index(a, b), risk_band(shade_wbgt_rh(a, b)) FROM air_rows")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Eval" not in plan


def test_clock_and_days(spark, rows):
    r = spark.sql("SELECT business_day(75599), business_day(75600), slot_of(1000), format_clock(0), format_day(75600)").first()
    assert list(r) == [0, 1, 900, "03:00", "Fri 2 Jan"]
