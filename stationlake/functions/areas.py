"""``area_samples`` as a table function of SQL: ``SELECT name, s.* FROM areas, LATERAL area_samples(geometry, 10) s``."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def _inside(x: float, y: float, ring: list) -> bool:
    """Even-odd rule; the last corner joins the first."""
    edges = zip(ring, ring[-1:] + ring[:-1], strict=True)
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2 == 1


@udtf(returnType="lng double, lat double, weight double")
class AreaSamples:
    """The centres of a regular grid over a GeoJSON polygon or multipolygon that lie in it and in none of its holes, weighted by the cosine of their latitude. Other geometries, flat ones, nulls
    and what isn't JSON have none."""

    def eval(self, geometry: str, divisions: int) -> Iterator[tuple]:
        try:
            found = json.loads(geometry or "")
            polygons = {"Polygon": lambda c: [c], "MultiPolygon": list}[found["type"]](found["coordinates"])
            corners = [c for p in polygons for c in p[0]]
        except (ValueError, KeyError, TypeError, IndexError):
            return
        if not corners or divisions is None:
            return
        west, east, south, north = (f(c[k] for c in corners) for k in (0, 1) for f in (min, max))
        if east <= west or north <= south:
            return
        for row in range(divisions):
            lat = south + (row + 0.5) * (north - south) / divisions
            for column in range(divisions):
                lng = west + (column + 0.5) * (east - west) / divisions
                if any(_inside(lng, lat, p[0]) and not any(_inside(lng, lat, hole) for hole in p[1:]) for p in polygons):
                    yield lng, lat, math.cos(math.radians(lat))


def register(spark: SparkSession) -> None:
    spark.udtf.register("area_samples", AreaSamples)
