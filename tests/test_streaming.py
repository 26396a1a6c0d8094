from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.operators import series, service
from stationlake.streaming import jobs, stateful


def test_a_later_batch_updates_its_slot(spark, tmp_path):
    """Two files that arrive one after the other share a slot: the sink ends with both."""
    rows = [(1, 0, 10.0, None), (1, 60, 20.0, 0.5), (1, 900, 30.0, None)]
    for k, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, "station_id long, s long, temp double, rain double").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "f0")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("ts", F.timestamp_seconds("s"))
    done = jobs.run_to_end(jobs.slots(stream, ["station_id"]), ["station_id", "slot"])
    assert sorted((r["slot"], r["temp"], r["rain"], r["n"]) for r in done.collect()) == [(0, 15.0, 0.5, 2), (900, 30.0, None, 1)]


def test_counter_state_is_carried(spark, tmp_path):
    start = 1_700_000_000 // 86400 * 86400 + 21600
    readings = [(1, start, 1.0), (1, start + 900, 2.0), (1, start + 1800, 1.5), (1, start + 86400, 0.5)]
    for k, row in enumerate(readings):
        spark.createDataFrame([(*row, 2.25)], "station_id long, t long, total double, prior double").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "f0")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    done = jobs.run_to_end(jobs.counter_totals(stream, ["station_id"]), ["station_id"])
    row = done.first()
    # 1.0 more, nothing for the dip, then the new day's 0.5 and the 0.25 that the day before ended with beyond its peak
    assert (row["t"], row["mm"]) == (start + 86400, 1.75)


def test_first_seen(spark, tmp_path):
    spark.createDataFrame([(1, 1000), (1, 1000), (2, 1060)], "k long, s long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.source(spark, str(tmp_path / "in"), "*.parquet", lambda d: d.withColumn("ts", F.timestamp_seconds("s")))
    done = jobs.run_to_end(jobs.first_seen(stream, ["k"]), ["k"], mode="append")
    assert sorted(r["k"] for r in done.collect()) == [1, 2]


def arriving(spark, folder, batches, schema):
    """A stream of one file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/f{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_a_latch_holds_over_batches(spark, tmp_path):
    day = 86400
    batches = [[(1, 100, False), (1, 200, True), (2, 100, None)], [(1, 300, True), (2, 250, True)], [(1, 250, True), (1, day, True), (1, 2 * day + 1, True)]]
    told = stateful.to_end(stateful.fired_today(arriving(spark, tmp_path, batches, "k long, t long, wanted boolean"), ["k"]), ["k", "t"])
    assert sorted((r["k"], r["t"]) for r in stateful.on_time(told).collect()) == [(1, 200), (1, day), (1, 2 * day + 1), (2, 250)]
    assert [(r["k"], r["t"]) for r in stateful.late(told).collect()] == [(1, 250)]


def test_dwelling_equals_the_batch_whatever_the_batches(spark, tmp_path):
    labels = [None, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 2, 1, 1, 3, 3, 3], [2, 3, 3, 3, 3, 3], [2, 3, 2, 3], [1, None, 1, 1, 2, None, 1, 1, 2, 2, 2, 2]
    rows = [(k, t, x) for k, of in enumerate(labels) for t, x in enumerate(of)]
    batches = [[r for r in rows if r[1] // 3 == b] for b in range(7)]
    told = stateful.to_end(stateful.dwelling(arriving(spark, tmp_path, batches, "k long, t long, label long"), ["k"]), ["k", "t"])
    batch = series.smooth(spark.createDataFrame(rows, "k long, slot long, label long"), ["k"], "label").collect()
    assert {(r["k"], r["t"]): r["state"] for r in told.collect()} == {(r["k"], r["slot"]): r["state"] for r in batch}


def test_the_limit_is_kept_over_batches(spark, tmp_path):
    times = [0, 10, 20, 20, 90, 100, 109, 111, 200, 205, 206]
    rows = [(7, t, e) for e, t in enumerate(times)]
    told = stateful.to_end(stateful.limited(arriving(spark, tmp_path, [rows[:3], rows[3:4], rows[4:]], "k long, t long, event_id long"), ["k"], 3, 100), ["k", "event_id"])
    got = [r["admitted"] for r in sorted(told.collect(), key=lambda r: r["event_id"])]
    assert got == service.admit(times, 3, 100)
