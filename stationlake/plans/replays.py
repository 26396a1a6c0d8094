"""Days replayed, hour by hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..operators import replay, series
from .outlook import FIT_SQL, KEYS, fitted, r1
from .registry import query

_SQL = f"""{FIT_SQL},
    seen AS (SELECT u.station_id, u.slot, u.temp, u.usual, n IS NOT NULL AS ok FROM usual u JOIN dense USING (station_id, slot)),
    hours AS (SELECT station_id, day, day * 86400 + h * 3600 AS anchor FROM (SELECT station_id, unnest(generate_series(min(slot) // 86400, max(slot) // 86400)) AS day FROM seen GROUP BY 1), (SELECT unnest(range(3, 16)) AS h)),
    newest AS (SELECT h.*, s.slot AS observed_at, s.temp AS held, s.usual AS u0 FROM hours h ASOF LEFT JOIN (SELECT * FROM seen WHERE ok) s ON s.station_id = h.station_id AND s.slot <= h.anchor),
    frames AS (SELECT station_id, day, anchor, CASE WHEN fresh THEN observed_at END AS observed_at, CASE WHEN fresh THEN held END AS held, CASE WHEN fresh THEN u0 END AS u0, fresh AS available
        FROM (SELECT *, coalesce(anchor - observed_at <= 10800 AND observed_at >= day * 86400, false) AS fresh FROM newest)),
    path AS (SELECT f.*, step, observed_at + step * 900 AS target, t.usual AS u1 FROM frames f CROSS JOIN (SELECT unnest(range(0, 37)) AS step) LEFT JOIN seen t ON t.station_id = f.station_id AND t.slot = observed_at + step * 900 WHERE available),
    pts AS (SELECT p.*, CASE WHEN p.step = 0 THEN held WHEN u0 IS NOT NULL AND u1 IS NOT NULL THEN {r1('u1 + a * (held - u0)')} ELSE {r1('held')} END AS value,
            CASE WHEN p.step = 0 THEN 0 WHEN u0 IS NOT NULL AND u1 IS NOT NULL THEN band ELSE persistence END AS w
        FROM path p LEFT JOIN fits USING (step) LEFT JOIN bands b ON b.step = p.step AND b.block = p.target % 86400 // 10800),
    said AS (SELECT *, CASE WHEN step = 0 THEN value ELSE {r1('value - w')} END AS lower, CASE WHEN step = 0 THEN value ELSE {r1('value + w')} END AS upper FROM pts),
    checked AS (SELECT said.station_id, day, anchor, step // 4 AS hours, target, value, lower, upper, {r1('s.temp')} AS recorded, {r1('value - ' + r1('s.temp'))} AS error, {r1('held - ' + r1('s.temp'))} AS held_error
        FROM said LEFT JOIN (SELECT * FROM seen WHERE ok) s ON s.station_id = said.station_id AND s.slot = target WHERE step IN (4, 12, 24, 36))"""


def _parts(spark, sf_dir):
    g, fits, _, bands = fitted(spark, sf_dir)
    g = series.rolling_usual(g, KEYS, "temp", least=5)
    ok = F.col("n").isNotNull()
    shown = replay.frames(g, KEYS, "temp", ok)
    said = replay.forecasts(shown, g, KEYS, "usual", fits, bands)
    return shown, said, g.filter(ok).select("station_id", "slot", F.col("temp").alias("recorded"))


@query(f"""WITH {_SQL},
    cand AS (SELECT station_id, anchor, start, count(*) AS n, max(value) AS peak, avg(value) AS mean, avg(upper - lower) AS width FROM (SELECT *, target - k * 900 AS start FROM said, (SELECT unnest(range(0, 4)) AS k)) GROUP BY 1, 2, 3
        HAVING count(*) = 4 AND start % 86400 BETWEEN 12600 AND 56100 AND (start + 3600) % 86400 BETWEEN 12600 AND 56100),
    best AS (SELECT station_id, anchor, start FROM cand QUALIFY row_number() OVER (PARTITION BY station_id, anchor ORDER BY CASE WHEN peak < 18 THEN 0 WHEN peak < 21 THEN 1 WHEN peak < 24 THEN 2 ELSE 3 END,
        floor(peak / 0.05::DOUBLE + 1e-6), floor(width / 0.1::DOUBLE + 1e-6), floor(mean * 1e6 + 0.5), start) = 1),
    both_ AS (SELECT station_id, anchor, start, (start + 10800) // 86400 * 86400 + 32400 AS noon FROM best),
    peaks AS (SELECT b.station_id, b.anchor, b.start, b.noon, CASE WHEN count(*) FILTER (s.slot >= b.start AND s.slot < b.start + 3600) = 4 THEN max(s.temp) FILTER (s.slot >= b.start AND s.slot < b.start + 3600) END AS p,
            CASE WHEN count(*) FILTER (s.slot >= b.noon AND s.slot < b.noon + 3600) = 4 THEN max(s.temp) FILTER (s.slot >= b.noon AND s.slot < b.noon + 3600) END AS q
        FROM both_ b LEFT JOIN seen s ON s.station_id = b.station_id AND s.ok AND s.slot >= least(b.start, b.noon) AND s.slot < greatest(b.start, b.noon) + 3600 GROUP BY 1, 2, 3, 4)
    SELECT f.station_id, f.day, f.anchor, available, observed_at, {r1('held')} AS held, start AS best_start, {r1('p')} AS best_peak, noon AS noon_start, {r1('q')} AS noon_peak FROM frames f LEFT JOIN peaks USING (station_id, anchor)""")
def replay_frames(spark, sf_dir):
    """Q25: thirteen hours of every day, each from its newest slot if that isn't over three hours old, with the window it would have chosen against the one at noon."""
    shown, said, recorded = _parts(spark, sf_dir)
    found = shown.join(replay.window_records(said, recorded, KEYS), ["station_id", "anchor"], "left")
    return found.select("station_id", "day", "anchor", "available", "observed_at", half_up(F.col("held"), 1).alias("held"), "best_start", "best_peak", "noon_start", "noon_peak")


@query(f"WITH {_SQL} SELECT * FROM checked")
def replay_checks(spark, sf_dir):
    """Each frame's forecasts against what was recorded when they came due, and against holding its reading."""
    _, said, recorded = _parts(spark, sf_dir)
    return replay.checks(said, recorded, KEYS)


def _r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.500001) / 100"


@query(f"""WITH {_SQL} SELECT station_id, day, hours, count(*) AS n, {_r2('avg(abs(error))')} AS mae, {_r2('avg(abs(held_error))')} AS held_mae, {_r2('avg((recorded BETWEEN lower AND upper)::INTEGER)')} AS within
    FROM checked WHERE error IS NOT NULL GROUP BY 1, 2, 3""")
def replay_days(spark, sf_dir):
    """The errors of each day replayed by hours ahead."""
    _, said, recorded = _parts(spark, sf_dir)
    return replay.summary(replay.checks(said, recorded, KEYS), KEYS)
