"""Queries against their SQL on small tables that hold what the test tables don't."""

from __future__ import annotations

import datetime
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from stationlake import plans
from stationlake.operators import forecast, outlook

START = datetime.datetime(2024, 1, 1)


def with_events(path, rows):
    """A folder with a table of events, of rows (seconds, user_id, event_type, value)."""
    con = duckdb.connect()
    con.sql("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, NULL)", [(i, START + datetime.timedelta(seconds=s), *rest) for i, (s, *rest) in enumerate(rows)])
    con.sql(f"COPY e TO '{path}/events.parquet'")
    return str(path)


def equals_sql(spark, folder, name):
    found = plans.QUERIES[name](spark, folder)
    rows = found.collect()
    compare(rows, found.columns, connect(folder).sql(plans.ORACLES[name]))
    return rows


@pytest.mark.parametrize("showers", [range(0, 4 * 672), range(1344, 4 * 672), range(0)])
def test_rain_backtest_where_it_always_or_never_rained(spark, tmp_path, showers):
    """What weeks before taught is certain there, and scores no error, or one that nothing can be held against. The first week lacks hours."""
    rows = [(900 * i, 0, "view", float(i * 37 % 300)) for i in range(40, 4 * 672)] + [(900 * i, 0, "purchase", 200.0) for i in showers if i >= 40]
    found = equals_sql(spark, with_events(tmp_path, rows), "rain_backtest")
    assert any(r["skill"] == -math.inf or math.isnan(r["skill"]) for r in found)


def test_rates_of_cells_without_a_past(spark):
    rows = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 1, 1), (3, 0, 1), (3, 1, 1)], "week int, hour int, wet int")
    found = {(r["week"], r["hour"]): (r["rate"], r["base"]) for r in outlook.rain_rates(rows, "week", "hour", "wet").collect()}
    assert found == {(2, 0): (1.0, 1.0), (2, 1): (None, 1.0), (3, 0): (0.5, 2 / 3), (3, 1): (1.0, 2 / 3)}


def test_flood_counts_of_heavy_rain(spark, tmp_path):
    """From 600 on the band would turn on the soil, but it is raised on any."""
    values = [0.0, 99.9, 100.0, 299.9, 300.0, 599.9, 600.0, 1e6, math.inf, math.nan, None]
    found = equals_sql(spark, with_events(tmp_path, [(i, i, "purchase", v) for i, v in enumerate(values)]), "flood_counts")
    assert {r["risk"]: r["n"] for r in found} == {"LOW": 2, "unknown": 3, "ELEVATED": 6}


def test_percentiles_are_those_of_the_values(spark):
    """Ties, one value, neighbours in different bins, and values that aren't counted by hundredths."""
    rng = np.random.default_rng(4)
    sets = {1: rng.exponential(3, 501).tolist(), 2: [0.1234], 3: [0.5] * 40 + [7.0] * 11, 4: [1.0, 1.001, 1.002, 1.003], 5: rng.integers(0, 5, 300).astype(float).tolist()}
    rows = spark.createDataFrame([(k, v) for k, values in sets.items() for v in [*values, None]], "step int, v double").repartition(5)
    found = {r["step"]: r["p"] for r in forecast.percentile(rows, ["step"], F.col("v"), 0.8, "p").collect()}
    assert found == {k: pytest.approx(np.percentile(v, 80), abs=1e-12) for k, v in sets.items()}


def test_bands_of_the_final_fit_are_of_errors_as_they_are(spark, sf_dir):
    _, _, held, _ = plans.outlook.fitted(spark, sf_dir)
    errors = held.filter(F.col("slot") < plans.outlook.TEST).groupBy("step").agg(F.collect_list(F.abs("e")).alias("e")).collect()
    want = {r["step"]: math.floor(np.percentile(r["e"], 80) * 1e4 + 0.500001) / 1e4 for r in errors}
    found = {r["step"]: r["band80"] for r in plans.QUERIES["final_fit"](spark, sf_dir).collect()}
    assert found == {k: want[k] for k in found} and found
    assert {r["step"]: r["band80"] for r in plans.QUERIES["model_registry"](spark, sf_dir).collect()} == {k: found[k] for k in (1, 4, 12)}
