"""Batched requests for many places, samples of areas."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stationlake.functions import areas
from stationlake.operators import spatial
from stationlake.sources import places
from stationlake.sources.places import PlaceReader


def options(names, **more):
    listed = [[n, float(i), 37.0] for i, n in enumerate(names)]
    return {"fetch": "feed_stub:places", "places": json.dumps(listed), "start": "0", "end": "7200"} | {k: str(v) for k, v in more.items()}


@pytest.fixture
def read(spark):
    places.register(spark)
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("feed_stub.py")))
    return lambda names, **more: spark.read.format("place_weather").options(**options(names, **more)).load()


def test_batches_and_requests_in_flight(read):
    df = read([f"p{i}" for i in range(95)])
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert len(rows) == 190 and {r["channel"].split(":")[1] for r in rows} == {"40", "15"}
    assert len(PlaceReader(options([f"p{i}" for i in range(1000)])).partitions()) == 4
    assert read([]).count() == 0


def test_a_failed_batch_gives_nulls(read):
    rows = read(["a", "b", "bad", "c", "none"], batch=2).collect()
    by = {n: [r["value"] for r in rows if r["place"] == n] for n in ("a", "b", "bad", "c", "none")}
    assert by == {"a": [0.0, 3600.0], "b": [1.0, 3601.0], "bad": [None], "c": [None], "none": [None]}


def test_filters_narrow_what_is_asked_for(spark, read):
    found = read(["a", "b", "c"]).filter(F.col("place").isin("a", "c") & (F.col("t") >= 3600)).collect()
    assert sorted((r["place"], r["t"], r["channel"]) for r in found) == [(p, 3600, "asked:2:3600:7200") for p in ("a", "c")]


SQUARE = [[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [3, 1], [3, 3], [1, 3]]]


def test_the_table_function_equals_the_columns(spark):
    areas.register(spark)
    shapes = {"ring": [SQUARE], "two": [SQUARE, [[[5, 0], [6, 0], [6, 1], [5, 1]]]], "corner": [[[[0, 0], [2, 0], [0, 2]]]]}
    rows = [(n, [[[[float(x) for x in c] for c in ring] for ring in p] for p in s], json.dumps({"type": "MultiPolygon", "coordinates": s})) for n, s in shapes.items()]
    df = spark.createDataFrame(rows, "area string, polygons array<array<array<array<double>>>>, geometry string")
    found = spark.sql("SELECT area, s.* FROM {df}, LATERAL area_samples(geometry, 20) s", df=df).collect()
    want = spatial.sample_area(df.drop("geometry"), 20).select("area", "lng", "lat", "weight").collect()
    near = lambda rows: sorted((r["area"], round(r["lng"], 9), round(r["lat"], 9), round(r["weight"], 9)) for r in rows)
    assert near(found) == near(want) and len(want) > 100


@pytest.mark.parametrize("geometry", [None, "", "{}", '{"type": "Point", "coordinates": [1, 2]}', '{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [2, 0]]]}', '{"type": "MultiPolygon", "coordinates": []}'])
def test_shapes_without_samples(spark, geometry):
    areas.register(spark)
    df = spark.createDataFrame([(geometry,)], "geometry string")
    assert spark.sql("SELECT s.* FROM {df}, LATERAL area_samples(geometry, 5) s", df=df).count() == 0


def test_interior_points_lie_inside(spark):
    """The middle of a square with a hole is in the hole, the point isn't."""
    rows = [("ring", [[[[float(x) for x in c] for c in ring] for ring in SQUARE]])]
    df = spark.createDataFrame(rows, "area string, polygons array<array<array<array<double>>>>")
    p = spatial.interior_points(spatial.sample_area(df), ["area"]).first()
    assert not (1 < p["lng"] < 3 and 1 < p["lat"] < 3) and 0 < p["lng"] < 4 and 0 < p["lat"] < 4
