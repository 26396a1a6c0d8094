"""Station archives and documents: CSV, GeoJSON, model files; and where results are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import numeric, parse_utc

#: Fixed value: the archive's columns, the time first.
COLUMNS = (
    "ts rg1 rg2 rg1tt rg2tt rg1tp rg2tp temp_bmx temp_mcp temp_sht press_bmx humidity_sht si1145_vis si1145_ir si1145_uv wind_spd wind_gust "
    "wind_dir wind_gust_dir heat_idx wet_bulb_temp wet_bulb_globe_temp"
).split()


def read_csv(spark: SparkSession, path: str, columns: list[str] = COLUMNS) -> DataFrame:
    """Rows as text. Files need a header that starts with ``ts``; a row that is shorter than the header has nulls at its end and
    goes, as does one whose time can't be read. Nothing is sorted: partitioned files keep the order that queries need."""
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(", ".join(f"`{c}` string" for c in [*columns, "_short"])).option("columnNameOfCorruptRecord", "_short").csv(path)
    return raw.filter(F.col("_short").isNull() & parse_utc(F.col("ts")).isNotNull()).drop("_short")


def typed(rows: DataFrame) -> DataFrame:
    """The time in UTC and all else as doubles; -999.9, empty and unreadable are null."""
    return rows.select(parse_utc(F.col("ts")).alias("ts"), *(numeric(F.col(c)).alias(c) for c in rows.columns if c != "ts"))


def repaired(rows: DataFrame) -> DataFrame:
    """From 2025-07-01 the ultraviolet reading stands in the second gauge's total: moved back, but for 3 to 5 July, and on 6 July only
    where none was read and the total isn't zero."""
    day = F.to_date("ts")
    late = day >= F.lit("2025-07-01").cast("date")
    between = day.between(F.lit("2025-07-03").cast("date"), F.lit("2025-07-05").cast("date"))
    sixth = (day == F.lit("2025-07-06").cast("date")) & ~((F.col("si1145_uv") == 0) & (F.col("rg2tt") > 0))
    moved = F.coalesce(late & ~between & ~sixth, F.lit(False))
    return rows.withColumns({"si1145_uv": F.when(moved, F.col("rg2tt")).otherwise(F.col("si1145_uv")), "rg2tt": F.when(~moved, F.col("rg2tt"))})


def write_partitioned(rows: DataFrame, path: str, time: str = "ts", keys: tuple[str, ...] = ("station_id",)) -> None:
    """Parquet by day, sorted within files, so that a range of time prunes folders and row groups."""
    dated = rows.withColumn("date", F.to_date(time))
    dated.repartition("date", *keys).sortWithinPartitions(*keys, time).write.mode("overwrite").partitionBy("date").parquet(path)


def read_range(spark: SparkSession, path: str, start: str, end: str, time: str = "ts") -> DataFrame:
    """Rows of [start, end]; the day is tested too, so that other days' folders aren't read."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return spark.read.parquet(path).filter(F.col("date").between(F.to_date(a), F.to_date(b)) & F.col(time).between(a, b))


def read_geojson(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """(area, polygons) of a feature collection; a polygon counts as a multipolygon of one. Other geometries go."""
    ring = "array<array<array<double>>>"
    schema = f"features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"  # noqa: F541
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, ring))).when(kind == "MultiPolygon", F.from_json(text, f"array<{ring}>"))
    return each.select(F.col("f.properties")[name].alias("area"), polygons.alias("polygons")).filter("polygons is not null")


def read_model(spark: SparkSession, path: str, steps: str = "steps") -> DataFrame:
    """One row for each step of a fitted model's file."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(steps))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document a row, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("document"))


def write_artefact(rows: DataFrame, path: str, name: str = "steps") -> None:
    """One JSON document with a short table as an array: fitted models of so many steps, scores of so many horizons, a report of so many
    stations. The table has to be bounded by its meaning, as the document is written by one task."""
    document = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))
    document.select(F.to_json(F.struct(name), {"ignoreNullFields": "false"})).coalesce(1).write.mode("overwrite").text(path)
