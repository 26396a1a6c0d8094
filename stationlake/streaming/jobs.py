"""Structured Streaming forms of the grid, deduplication, silences and counters.

Each job is a streaming DataFrame of its own; ``run_to_end`` runs it over what a source holds now and gives what the sink
then has, so that a batch can check it. State, offsets and output lie in the folder that the cluster shares.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.counters import fold
from ..storage import shared_dir


def run_to_end(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """What the sink holds once the source is read. Batches are appended with their number; of a key's rows the
    latest batch's counts, which makes a batch that is written twice after a failure harmless."""
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/stationlake-streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/n={number}")

    job = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True)
    job.start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{where}/out")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))
    return rows.withColumn("_k", newest).filter("_k = 1").drop("_k", "_batch")


def slots(readings: DataFrame, keys: list[str], width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling slots with a watermark: (keys, slot, temp, rain, n); ``readings`` has ``ts``."""
    grouped = readings.withWatermark("ts", late).groupBy(*keys, F.window("ts", width))
    out = grouped.agg(F.avg("temp").alias("temp"), F.sum("rain").alias("rain"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.unix_seconds("window.start").alias("slot"), "temp", "rain", "n")


def sliding(readings: DataFrame, keys: list[str], width: str = "3 hours", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Rain of each window of ``width``, one each ``step``."""
    out = readings.withWatermark("ts", late).groupBy(*keys, F.window("ts", width, step)).agg(F.sum("rain").alias("rain"))
    return out.select(*keys, F.unix_seconds("window.start").alias("start"), "rain")


def sessions(readings: DataFrame, keys: list[str], silence: str, late: str = "1 hour") -> DataFrame:
    """Stretches of readings without a silence: (keys, start, end, n); final ones only, so in append mode."""
    out = readings.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", silence).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n")


def first_seen(readings: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row a key within the watermark: the first that arrives. Where the last must win, the sink decides (``run_to_end``)."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def latest(readings: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The last row of each key, by its place: (keys, event_id, temp)."""
    out = readings.withWatermark("ts", late).groupBy(*keys, "ts").agg(F.max_by(F.struct("event_id", "temp"), "event_id").alias("r"))
    return out.select(*keys, F.unix_seconds("ts").alias("t"), "r.*")


def counter_totals(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Rain so far of each counter, (keys, t, mm): the batch fold with its state carried from batch to batch."""
    types = {f.name: f.dataType.simpleString() for f in readings.schema}
    fields = ", ".join(f"{k} {types[k]}" for k in keys)

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.getOption
        seen, last = (known[0], known[1:4]) if known else (0.0, None)
        rows = pd.concat(list(chunks)).sort_values("t", kind="stable")
        for mm, last in fold(zip(rows["t"].tolist(), rows["total"].tolist(), rows["prior"].tolist(), strict=True), last):
            seen += mm or 0.0
        if last:
            state.update((seen, *last))
        yield pd.DataFrame([[*key, int(rows["t"].max()), round(seen, 3)]], columns=[*keys, "t", "mm"])

    return readings.groupBy(*keys).applyInPandasWithState(
        step, f"{fields}, t long, mm double", "mm double, t long, peak double, restarted long", "update", GroupStateTimeout.NoTimeout
    )


def source(spark: SparkSession, folder: str, files: str, as_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream of the Parquet files in ``folder`` whose names match, with the schema that they have now."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    return as_rows(spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder))
