"""Areas sampled on a grid, and what is known of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import areas
from ..functions.rounding import half_up
from ..operators import spatial
from ..sources.testdata import table
from .registry import query, r4


def nation_areas(spark, sf_dir):
    """A square for each nation, every second one with a hole, every third with a part to its east, as polygons and as GeoJSON."""
    k = F.col("n_nationkey")
    x, y, size = (k % 5 * 10).cast("double"), (F.floor(k / 5) * 10).cast("double"), (4 + k % 3).cast("double")
    ring = lambda a, b, s: F.array(*(F.array(p, q) for p, q in ((a, b), (a + s, b), (a + s, b + s), (a, b + s))))
    square = F.when(k % 2 == 1, F.array(ring(x, y, size), ring(x + 1.05, y + 1.05, size - 2.1))).otherwise(F.array(ring(x, y, size)))
    polygons = F.when(k % 3 == 0, F.array(square, F.array(ring(x + size + 1, y, F.lit(1.5))))).otherwise(F.array(square))
    rows = table(spark, sf_dir, "nation").select(k.alias("area"), polygons.alias("polygons"))
    return rows.withColumn("geometry", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates"))))


_SQL = """a AS (SELECT n_nationkey AS area, (n_nationkey % 5 * 10)::DOUBLE AS x, (n_nationkey // 5 * 10)::DOUBLE AS y, (4 + n_nationkey % 3)::DOUBLE AS size FROM nation),
    b AS (SELECT *, CASE WHEN area % 3 = 0 THEN size + 2.5 ELSE size END AS wide FROM a),
    g AS (SELECT *, x + (c + 0.5) * wide / 10 AS lng, y + (r + 0.5) * size / 10 AS lat FROM b, (SELECT unnest(range(0, 10)) AS r), (SELECT unnest(range(0, 10)) AS c)),
    s AS (SELECT area, lng, lat, cos(radians(lat)) AS weight FROM g WHERE (lng < x + size AND NOT (area % 2 = 1 AND lng BETWEEN x + 1.05 AND x + size - 1.05 AND lat BETWEEN y + 1.05 AND y + size - 1.05))
        OR (area % 3 = 0 AND lng >= x + size + 1 AND lat < y + 1.5))"""


@query(f"""WITH {_SQL}, m AS (SELECT area, avg(lng) AS mx, avg(lat) AS my FROM s GROUP BY 1),
    p AS (SELECT s.*, row_number() OVER (PARTITION BY area ORDER BY round(sqrt(pow(lat - my, 2) + pow(lng - mx, 2)), 12), lat, lng) AS k FROM s JOIN m USING (area))
    SELECT area, count(*) AS samples, {r4('sum(weight)')} AS weight, {r4('max(lng) FILTER (k = 1)')} AS lng, {r4('max(lat) FILTER (k = 1)')} AS lat FROM p GROUP BY 1""")
def area_samples(spark, sf_dir):
    """Areas with holes and several parts sampled by a table function of SQL, and a point inside each."""
    areas.register(spark)
    found = spark.sql("SELECT area, s.* FROM {a}, LATERAL area_samples(geometry, 10) s", a=nation_areas(spark, sf_dir))
    counts = found.groupBy("area").agg(F.count(F.lit(1)).alias("samples"), half_up(F.sum("weight"), 4).alias("weight"))
    inside = spatial.interior_points(found, ["area"])
    return counts.join(inside, "area").select("area", "samples", "weight", half_up(F.col("lng"), 4).alias("lng"), half_up(F.col("lat"), 4).alias("lat"))


@query(f"""WITH {_SQL}, h AS (SELECT epoch_us(ts) // 3600000000 % 24 AS t, avg(least(value, 300)) / 15 AS base FROM events GROUP BY 1),
    v AS (SELECT area, weight, t, CASE WHEN floor(lng * 100 + lat * 10 + t + area) % 13 < area % 5 THEN NULL ELSE base + (lat - lng) / 10 END AS value FROM s CROSS JOIN h),
    e AS (SELECT area, t, sum(weight) AS total, coalesce(sum(weight) FILTER (value IS NOT NULL), 0) AS have, sum(value * weight) AS vw, min(value) AS lo, max(value) AS hi, coalesce(sum(weight) FILTER (value >= 21), 0) AS hot, count(value) AS valid, count(*) AS samples FROM v GROUP BY 1, 2),
    f AS (SELECT *, 100 * have / total >= 80 AND valid >= 2 AS ok FROM e)
    SELECT area, t, {r4('CASE WHEN ok THEN vw / have END')} AS mean, {r4('CASE WHEN ok THEN lo END')} AS min, {r4('CASE WHEN ok THEN hi END')} AS max, {r4('CASE WHEN ok THEN 100 * hot / have END')} AS above_pct, {r4('100 * have / total')} AS coverage_pct, valid, samples FROM f""")
def area_outlook(spark, sf_dir):
    """Q24: hourly figures of each area from its samples, kept back where too few of them have a value."""
    found = spatial.sample_area(nation_areas(spark, sf_dir).drop("geometry"))
    found = found.withColumn("place", F.concat_ws(":", "area", F.round("lng", 6), F.round("lat", 6)))
    e = table(spark, sf_dir, "events")
    t = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) % 24
    hours = e.groupBy(t.alias("t")).agg((F.avg(F.least("value", F.lit(300))) / 15).alias("base"))
    missing = F.floor(F.col("lng") * 100 + F.col("lat") * 10 + F.col("t") + F.col("area")) % 13 < F.col("area") % 5
    values = found.join(F.broadcast(hours)).select("place", "t", F.when(~missing, F.col("base") + (F.col("lat") - F.col("lng")) / 10).alias("value"))
    out = spatial.area_outlook(found, values.filter("value is not null"), ["area"])
    return out.withColumns({c: half_up(F.col(c), 4) for c in ("mean", "min", "max", "above_pct", "coverage_pct")})
