from __future__ import annotations

import json
from pathlib import Path

import pytest

from stationlake.sources import archive, feed


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "a.csv").write_text("ts,rg2tt,si1145_uv,temp_sht\n2025-07-02 00:00:00,0.5,0,-999.9\n2025-07-04 00:00:00,0.7,1,20\n2025-07-06 00:00:00,0.9,0,21\n2025-07-06 00:15:00,0,0,21\nno time,1,1,1\n2025-07-07 00:00:00,1\n2025-06-30 23:59:00,0.2,0,19.5\n")
    return str(tmp_path)


def test_csv_rows(spark, csv):
    rows = archive.typed(archive.read_csv(spark, csv, ["ts", "rg2tt", "si1145_uv", "temp_sht"]))
    got = {str(r["ts"]): r for r in rows.collect()}
    assert len(got) == 5 and got["2025-07-02 00:00:00"]["temp_sht"] is None and got["2025-07-04 00:00:00"]["temp_sht"] == 20.0


def test_column_repair(spark, csv):
    rows = archive.repaired(archive.typed(archive.read_csv(spark, csv, ["ts", "rg2tt", "si1145_uv", "temp_sht"])))
    got = {str(r["ts"])[5:16]: (r["rg2tt"], r["si1145_uv"]) for r in rows.collect()}
    assert got == {"07-02 00:00": (None, 0.5), "07-04 00:00": (0.7, 1.0), "07-06 00:00": (None, 0.9), "07-06 00:15": (0.0, 0.0), "06-30 23:59": (0.2, 0.0)}


def test_partitioned_range(spark, csv, tmp_path):
    rows = archive.typed(archive.read_csv(spark, csv, ["ts", "rg2tt", "si1145_uv", "temp_sht"]))
    where = str(tmp_path / "silver")
    archive.write_partitioned(rows, where, keys=())
    found = archive.read_range(spark, where, "2025-07-04", "2025-07-06 00:00:00")
    assert found.count() == 2
    assert "PartitionFilters: [isnotnull(date" in found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [
        {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
    ]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = {r["area"]: r["polygons"] for r in archive.read_geojson(spark, str(tmp_path / "g.json")).collect()}
    assert {k: len(v) for k, v in got.items()} == {"p": 1, "m": 2} and got["p"][0][0][1] == [1.0, 0.0]


def test_model_and_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"steps": [{"step": 1, "a": 0.9}, {"step": 4, "a": 0.8}]}))
    model = archive.read_model(spark, str(tmp_path / "m.json"))
    assert {(r["step"], r["a"]) for r in model.collect()} == {(1, 0.9), (4, 0.8)}
    assert json.loads(archive.as_json(spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b")).first()[0]) == {"a": 1, "b": None}


def test_feed(spark):
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("feed_stub.py")))
    spark.dataSource.register(feed.FeedSource)
    df = spark.read.format("station_feed").option("fetch", "feed_stub:fetch").option("start", 0).option("end", 1000).option("width", 300).load()
    assert df.rdd.getNumPartitions() == 4
    got = feed.pivoted(df, ["temp", "rain"]).orderBy("t").collect()
    assert [(r["t"], r["temp"], r["rain"]) for r in got] == [(t, t / 10, 1.0 if t % 200 == 0 else None) for t in range(0, 1000, 100)]


def test_feed_without_a_failed_stretch(spark):
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("feed_stub.py")))
    spark.dataSource.register(feed.FeedSource)
    options = {"fetch": "feed_stub:failing", "start": 0, "end": 1000, "width": 300}
    rows = spark.read.format("station_feed").options(**options, skip_failed="true").load().collect()
    assert [(r["t"], r["value"]) for r in rows if r["channel"] == feed.FAILED] == [(300, None)]
    assert sorted(r["t"] for r in rows if r["channel"] == "temp") == [0, 100, 200, 600, 700, 800, 900]
    with pytest.raises(Exception, match="no answer"):
        spark.read.format("station_feed").options(**options).load().collect()
