"""Requests and saved rows: rate limits, validation, plans, choices between sources."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def admit(times: Iterable[int], limit: int, width: int) -> list[bool]:
    """Sliding-window limit in which refused requests don't count."""
    kept: list[int] = []
    out = []
    for t in times:
        kept = [k for k in kept if k > t - width]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def rate_limited(requests: DataFrame, keys: list[str], limit: int, width: int, time: str = "t", tie: str = "event_id") -> DataFrame:
    """``admitted`` for each request. What is admitted hangs on all that was before, so a key's requests are folded in order, in chunks that no
    admission can reach across: a silence longer than ``width`` starts a new one, so a task holds one busy spell of one key."""
    from .series import runs

    near = F.col(time) - F.lag(time).over(_by(keys, time, tie)) < width
    spells = runs(requests.withColumn("_o", F.struct(time, tie)), keys, near, "_o").drop("_o")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spells.schema)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([time, tie], kind="stable")
        return group.assign(admitted=admit(group[time].tolist(), limit, width))

    return spells.groupBy(*keys, "run").applyInPandas(run, f"{fields}, admitted boolean").drop("run")


def _by(keys: list[str], *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def plan_problem(start: Column, end: Column, minutes: Column, now: Column, reach: Column) -> Column:
    """Why a plan can't be made, or null: the first that holds."""
    length = end - start
    return (
        F.when(start.isNull() | end.isNull(), "time_missing")
        .when(end <= start, "order")
        .when(length > 86400, "too_long")
        .when(length < minutes * 60, "too_short")
        .when(end <= now, "past")
        .when(end - F.greatest(start, now) < minutes * 60, "no_room_left")
        .when(F.greatest(start, now) + minutes * 60 > reach, "beyond_forecast")
    )


def next_occurrence(start_minute: Column, end_minute: Column, now: Column) -> Column:
    """Start of the current or next daily occurrence; one that ends before it starts goes over midnight. Times are local seconds."""
    midnight = now - F.pmod(now, F.lit(86400))
    length = F.pmod(end_minute - start_minute, F.lit(1440)) * 60
    today = midnight + start_minute * 60
    return F.when(today - 86400 + length > now, today - 86400).when(today + length > now, today).otherwise(today + 86400)


def choose_rain(gauge_days: Column, least: int = 6) -> Column:
    return F.when(gauge_days >= least, "station_gauge").otherwise("regional")


def choose_et0(station_hours: Column, least: int = 20) -> Column:
    return F.when(station_hours >= least, "station").otherwise("regional")


def link_account(known_subject: Column, email_owner: Column, verified: Column, owner_subject: Column, owner_proven: Column) -> Column:
    """What to do with a sign-in by an outside account whose address some account may have: an account that has another outside account is
    left alone, one whose owner never proved the address is claimed, which drops its password and sessions."""
    return (
        F.when(known_subject.isNotNull(), "sign_in")
        .when(~verified, "refuse_unverified")
        .when(email_owner.isNull(), "create")
        .when(owner_subject.isNotNull(), "refuse_conflict")
        .when(owner_proven, "link")
        .otherwise("claim")
    )


def mail_caps(sent: DataFrame, users: DataFrame, key: str, now: Column, per_user: int, overall: int, time: str = "t") -> DataFrame:
    """For each of ``users``: mails of the last hour to it and to all, and which cap stops one more."""
    recent = sent.filter(F.col(time) >= now - 3600)
    own = recent.groupBy(key).agg(F.count(F.lit(1)).alias("own_last_hour"))
    every = recent.agg(F.count(F.lit(1)).alias("all_last_hour"))
    rows = users.select(key).join(own, key, "left").crossJoin(F.broadcast(every)).fillna(0, ["own_last_hour"])  # one row
    cap = F.when(F.col("all_last_hour") >= overall, "global").when(F.col("own_last_hour") >= per_user, "address").otherwise("ok")
    return rows.withColumn("cap", cap)


def trend(later: Column, now: Column, step: float = 0.3) -> Column:
    change = later - now
    return F.when(change > step, "rising").when(change < -step, "falling").when(change.isNotNull(), "steady")


def shares_of_largest(effect: Column, over) -> Column:
    """|effect| as a share of the largest in its group; null unless each has a value."""
    return F.when(F.bool_and(effect.isNotNull()).over(over), F.abs(effect) / F.max(F.abs(effect)).over(over))
