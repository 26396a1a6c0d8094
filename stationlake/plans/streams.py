"""Streaming queries, run to the end of the source; the SQL is that of the same batch."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..sources.testdata import READINGS_SQL, station_rows
from ..streaming import jobs, stateful
from .health import SMOOTH_SQL, labelled
from .registry import ORACLES, query, r4

KEYS = ["station_id"]


def readings(spark, sf_dir):
    def as_rows(events):
        return station_rows(events).withColumn("ts", F.timestamp_seconds("t"))

    return jobs.source(spark, sf_dir, "events.parquet", as_rows)


@query(f"WITH {READINGS_SQL} SELECT station_id, t - t % 900 AS slot, {r4('avg(temp)')} AS temp, {r4('sum(rain)')} AS rain, count(*) AS n FROM readings GROUP BY 1, 2")
def stream_grid(spark, sf_dir):
    """Tumbling slots."""
    done = jobs.run_to_end(jobs.slots(readings(spark, sf_dir), KEYS), ["station_id", "slot"])
    return done.withColumns({c: half_up(F.col(c), 4) for c in ("temp", "rain")})


@query(f"""WITH {READINGS_SQL} SELECT station_id, t - t % 900 - k * 900 AS start, {r4('sum(rain)')} AS rain FROM readings CROSS JOIN generate_series(0, 11) s(k) GROUP BY 1, 2""")
def stream_sliding_rain(spark, sf_dir):
    """Rain of three hours from each quarter hour."""
    done = jobs.run_to_end(jobs.sliding(readings(spark, sf_dir), KEYS), ["station_id", "start"])
    return done.withColumn("rain", half_up(F.col("rain"), 4))


@query(f"WITH {READINGS_SQL} SELECT station_id, t, max(event_id) AS event_id, {r4('max_by(coalesce(temp, -999), event_id)')} AS temp FROM readings GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    """The last row of a station and instant wins."""
    done = jobs.run_to_end(jobs.latest(readings(spark, sf_dir), KEYS), ["station_id", "t"])
    return done.withColumn("temp", half_up(F.coalesce("temp", F.lit(-999.0)), 4))


@query(f"""WITH {READINGS_SQL}, g AS (SELECT station_id, t, coalesce((t - lag(t) OVER w > 3600)::INTEGER, 0) AS cut FROM readings WINDOW w AS (PARTITION BY station_id ORDER BY t)),
    s AS (SELECT station_id, t, sum(cut) OVER (PARTITION BY station_id ORDER BY t) AS k FROM g), p AS (SELECT station_id, k, min(t) AS start, max(t) + 3600 AS "end", count(*) AS n FROM s GROUP BY 1, 2)
    SELECT station_id, start, "end", n FROM p WHERE "end" <= (SELECT max(t) FROM readings) - 3600""")
def stream_session_gap(spark, sf_dir):
    """Stretches without a silence of more than an hour; those that the watermark has passed are final."""
    return jobs.run_to_end(jobs.sessions(readings(spark, sf_dir), KEYS, "1 hour"), ["station_id", "start"], mode="append")


@query(f"""WITH {READINGS_SQL}, r AS (SELECT station_id, t, sum(rain) AS rain FROM readings WHERE rain IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT station_id, t, event_total, lag(event_total) OVER (PARTITION BY station_id ORDER BY t) AS before,
        (t - 21600) // 86400 - (lag(t) OVER (PARTITION BY station_id ORDER BY t) - 21600) // 86400 AS days FROM (SELECT station_id, t, floor(sum(rain) OVER (PARTITION BY station_id ORDER BY t) * 1000 + 0.500001) / 1000 AS event_total FROM r))
    SELECT station_id, max(t) AS t, {r4('sum(floor((event_total - CASE WHEN days >= 2 THEN 0 ELSE before END) * 1000 + 0.5) / 1000)')} AS mm FROM c GROUP BY 1""")
def stream_counter(spark, sf_dir):
    """W11 online: a counter that only grows, folded with its state from batch to batch; after a silent day all of it is new."""
    from ..sources.testdata import readings as batch

    r = batch(spark, sf_dir).filter("rain is not null").groupBy("station_id", "t").agg(F.sum("rain").alias("rain"))
    total = F.floor(F.sum("rain").over(Window.partitionBy("station_id").orderBy("t")) * 1000 + 0.500001) / 1000
    where = f"{jobs.shared_dir(spark)}/stationlake-streams/counter-{uuid.uuid4().hex}"
    r.select("station_id", "t", total.alias("total"), F.lit(None).cast("double").alias("prior")).write.parquet(where)
    stream = jobs.counter_totals(jobs.source(spark, where, "*.parquet", lambda rows: rows), KEYS)
    return jobs.run_to_end(stream, KEYS).withColumn("mm", half_up(F.col("mm"), 4))


def stored(df, name):
    """A folder that the cluster shares with ``df`` in it, to be read as a stream."""
    where = f"{jobs.shared_dir(df.sparkSession)}/stationlake-streams/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return where


@query(f"WITH {READINGS_SQL} SELECT station_id, min(t) AS t, (t + 10800) // 86400 AS day FROM readings WHERE temp > 30 GROUP BY 1, 3")
def stream_fired_today(spark, sf_dir):
    """A rule that fires once a local day: its latch is kept from batch to batch."""
    hot = readings(spark, sf_dir).select("station_id", "t", (F.col("temp") > 30).alias("wanted"))
    return stateful.on_time(stateful.to_end(stateful.fired_today(hot, KEYS), ["station_id", "t"]))


@query(f"WITH {SMOOTH_SQL} SELECT * FROM smooth")
def stream_dwell(spark, sf_dir):
    """W14 online: labels that count once they lasted; the SQL is that of the batch."""
    where = stored(labelled(spark, sf_dir).select("station_id", F.col("slot").alias("t"), F.col("label").cast("long").alias("label")), "labels")
    stream = jobs.source(spark, where, "*.parquet", lambda rows: rows)
    done = stateful.on_time(stateful.to_end(stateful.dwelling(stream, KEYS), ["station_id", "t"]))
    return done.filter("state is not null").select("station_id", F.col("t").alias("slot"), F.col("state").cast("int").alias("state"))


@query(ORACLES["rate_limit"])
def stream_rate_limit(spark, sf_dir):
    """Q29 online: a sliding limit whose kept times are the state."""
    def requests(events):
        return events.select("event_id", (F.col("user_id") % 50).alias("client"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))

    stream = jobs.source(spark, sf_dir, "events.parquet", requests)
    done = stateful.on_time(stateful.to_end(stateful.limited(stream, ["client"], 3, 43200), ["client", "event_id"]))
    return done.select("event_id", "client", "admitted")
