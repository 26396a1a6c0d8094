"""Points in polygons, samples of areas, and their weighted summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule over a ring, an array of (lng, lat) arrays; the last corner joins the first."""
    edges = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.size(ring) - 1)).alias("b"))

    def crosses(e):
        a, b = e["a"], e["b"]
        spans = (a[1] > lat) != (b[1] > lat)
        return F.when(spans, lng < (b[0] - a[0]) * (lat - a[1]) / (b[1] - a[1]) + a[0]).otherwise(False)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def contains(lng: Column, lat: Column, polygons: Column) -> Column:
    """Polygons, each an outer ring and holes: in some outer ring and in none of its holes."""
    return F.exists(polygons, lambda p: in_ring(lng, lat, p[0]) & ~F.exists(F.slice(p, F.lit(2), F.size(p)), lambda h: in_ring(lng, lat, h)))


def locate(points: DataFrame, areas: DataFrame, cell: float = 1.0, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """Points with the areas (``polygons`` array<array<array<array<double>>>>) that hold them. Areas are dealt over the grid
    cells of their bounding boxes, and a point meets only the areas of its cell."""
    corners = F.flatten(F.transform("polygons", lambda p: p[0]))
    low = lambda k: F.floor(F.array_min(F.transform(corners, lambda c: c[k])) / cell)
    high = lambda k: F.floor(F.array_max(F.transform(corners, lambda c: c[k])) / cell)
    dealt = areas.withColumn("_x", F.explode(F.sequence(low(0), high(0)))).withColumn("_y", F.explode(F.sequence(low(1), high(1))))
    met = points.withColumns({"_x": F.floor(F.col(lng) / cell), "_y": F.floor(F.col(lat) / cell)}).join(dealt, ["_x", "_y"])
    return met.filter(contains(F.col(lng), F.col(lat), F.col("polygons"))).drop("_x", "_y", "polygons")


def sample_area(areas: DataFrame, divisions: int = 10) -> DataFrame:
    """Centres of a regular grid over each area that lie in it, weighted by the cosine of their latitude; holes are left out."""
    corners = F.flatten(F.transform("polygons", lambda p: p[0]))
    at = lambda f, k: f(F.transform(corners, lambda c: c[k]))
    boxed = areas.withColumns({"_w": at(F.array_min, 0), "_e": at(F.array_max, 0), "_s": at(F.array_min, 1), "_n": at(F.array_max, 1)}).filter("_e > _w and _n > _s")
    steps = F.sequence(F.lit(0), F.lit(divisions - 1))
    cells = boxed.withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps))
    lat = F.col("_s") + (F.col("_r") + 0.5) * (F.col("_n") - F.col("_s")) / divisions
    lng = F.col("_w") + (F.col("_c") + 0.5) * (F.col("_e") - F.col("_w")) / divisions
    cells = cells.withColumns({"lat": lat, "lng": lng}).filter(contains(F.col("lng"), F.col("lat"), F.col("polygons")))
    return cells.withColumn("weight", F.cos(F.radians("lat"))).drop("polygons", "_w", "_e", "_s", "_n", "_r", "_c")


def summary(samples: DataFrame, keys: list[str], value: str = "value", weight: str = "weight", threshold: float = 21.0) -> DataFrame:
    """Weighted mean, extremes and share at or above a threshold, all null below 80 % coverage or two values; coverage is told."""
    v, w = F.col(value), F.col(weight)
    known = F.when(v.isNotNull(), w)
    total, have = F.sum(w), F.coalesce(F.sum(known), F.lit(0.0))
    enough = (100 * have / total >= 80) & (F.count(v) >= 2)
    return samples.groupBy(*keys).agg(
        F.when(enough, F.sum(v * w) / have).alias("mean"),
        F.when(enough, F.min(v)).alias("min"),
        F.when(enough, F.max(v)).alias("max"),
        F.when(enough, 100 * F.coalesce(F.sum(F.when(v >= threshold, w)), F.lit(0.0)) / have).alias("above_pct"),
        (100 * have / total).alias("coverage_pct"),
        F.count(v).alias("valid"),
        F.count(F.lit(1)).alias("samples"),
    )


def interior_points(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lng, lat) of the sample that is nearest to the mean of an area's samples, the first from south and west of equals. Unlike a mean of corners it lies in the area,
    also where that is concave, has holes or several parts."""
    means = samples.groupBy(*keys).agg(F.avg("lng").alias("_x"), F.avg("lat").alias("_y"))
    apart = F.hypot(F.col("lat") - F.col("_y"), F.col("lng") - F.col("_x"))
    near = F.min_by(F.struct("lng", "lat"), F.struct(F.round(apart, 12), "lat", "lng")).alias("p")
    return samples.join(means, keys).groupBy(*keys).agg(near).select(*keys, "p.*")


def area_outlook(samples: DataFrame, values: DataFrame, keys: list[str], time: str = "t", threshold: float = 21.0) -> DataFrame:
    """The figures of ``summary`` for each area and time: ``samples`` has the keys, place and weight, ``values`` place, time and value. A sample without a value at a time that any has counts as
    missing, and against the coverage."""
    times = values.filter(F.col(time).isNotNull()).select(time).distinct()
    every = samples.select(*keys, "place", "weight").join(times)  # a forecast's few hours
    met = every.join(values.select("place", time, "value"), ["place", time], "left")
    return summary(met, [*keys, time], threshold=threshold)
