from __future__ import annotations

import pytest

from stationlake import api
from stationlake.sources.testdata import readings


@pytest.mark.parametrize(
    "ask,columns",
    [
        (api.situation, {"station_id", "slot", "wbgt", "band", "change_1h", "filled_share"}),
        (api.forecasts, {"station_id", "slot", "step", "target", "value"}),
        (lambda r: api.best_windows(r, 7200), {"station_id", "day", "start", "end", "rank", "peak"}),
        (api.history, {"station_id", "day", "mm", "rain_hours", "t_max", "t_min", "temp_hours"}),
        (api.hits, {"station_id", "slot", "rule", "channel", "flag"}),
        (api.depletion, {"station_id", "depletion"}),
    ],
)
def test_answers(spark, sf_dir, ask, columns):
    found = ask(readings(spark, sf_dir))
    assert set(found.columns) == columns
    assert found.count() > 0
    assert ask(readings(spark, sf_dir).limit(0)).count() == 0


def test_depletion_stays_in_bounds(spark, sf_dir):
    assert all(0 <= r["depletion"] <= 96 for r in api.depletion(readings(spark, sf_dir)).collect())


def test_more_questions(spark, sf_dir):
    from stationlake.sources.testdata import readings, table

    r = readings(spark, sf_dir)
    assert api.clean(r).filter("temp is null or rain is null").count() == 0
    assert api.rainfall(r, least_hours=1).count() == 4 == api.longest_silence(r).count()
    planned = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 4 as station_id", "9 as start_hour", "12 as end_hour", "0D as offset_c")
    assert api.activities(r, planned, 1706486400).filter("peak is not null").count() == planned.count()
