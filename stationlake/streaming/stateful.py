"""Streams whose rows hang on all that came before: latches, smoothing, limits. Each keeps what it needs of a key in typed state and nothing else.

Rows of a key come in time order, batch after batch. A row that is older than the newest one of its key changes nothing that has been told: it is passed on with
``kind`` ``late``, for a side table (``on_time``, ``late``). Results come in update mode; ``jobs.run_to_end`` keeps the last one of each row.
State stores are RocksDB's, as Spark asks of such operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import run_to_end

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY, LOCAL = 86400, 10800


def _key_fields(rows: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


class _InOrder(StatefulProcessor):
    """Splits a key's rows into those that follow the newest so far and late ones; ``follow`` does the work on the first."""

    def __init__(self, keys: list[str], columns: dict[str, str]):
        self.keys, self.columns = keys, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "t long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def follow(self, rows: pd.DataFrame) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.newest.get()[0] if self.newest.exists() else None
        every = pd.concat(list(rows)).sort_values(self.order(), kind="stable")
        late = every["t"] < seen if seen is not None else pd.Series(False, index=every.index)
        told = [(*key, int(t), "late", *[None] * len(self.columns)) for t in every["t"][late]]
        on_time = every[~late]
        if len(on_time):
            told += [(*key, int(t), "told", *rest) for t, *rest in self.follow(on_time)]
            self.newest.update((int(on_time["t"].iloc[-1]),))
        if told:
            yield pd.DataFrame(told, columns=[*self.keys, "t", "kind", *self.columns]).astype(self.columns)

    def order(self) -> list[str]:
        return ["t"]

    def close(self) -> None:
        pass


class Latch(_InOrder):
    """Tells the first row of a local day for which ``wanted`` holds, and no other of that day."""

    def __init__(self, keys: list[str], ttl: int | None):
        super().__init__(keys, {"day": "Int64"})
        self.ttl = ttl

    def open(self, handle):
        self.fired = handle.getValueState("fired", "day long", self.ttl)

    def follow(self, rows):
        day = self.fired.get()[0] if self.fired.exists() else None
        for t in rows["t"][rows["wanted"].eq(True)]:
            if (int(t) + LOCAL) // DAY != day:
                day = (int(t) + LOCAL) // DAY
                yield t, day
        if day is not None:
            self.fired.update((day,))


class Dwell(_InOrder):
    """The state of each row by the rule that a label counts once it lasted for ``least`` labelled rows. A row is told at once, by what is known then, and again if it turns out
    that its run lasted, or, ahead of the first label that lasted, whenever the label changes."""

    def __init__(self, keys: list[str], least: int):
        super().__init__(keys, {"state": "Int64"})
        self.least = least

    def open(self, handle):
        self.at = handle.getValueState("at", "settled long, label long, length long")
        self.waiting = handle.getListState("waiting", "t long")

    def follow(self, rows):
        settled, label, length = self.at.get() if self.at.exists() else (None, None, 0)
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        told: dict[int, int | None] = {}
        for t, x in zip(rows["t"], rows["label"], strict=True):
            t = int(t)
            if pd.isna(x):
                told[t] = None
                continue
            if label is None or int(x) != label:
                label, length = int(x), 0
                if settled is not None:
                    waiting = []
            length += 1
            if length >= self.least:
                told.update(dict.fromkeys(waiting, label))
                settled, waiting = label, []
                told[t] = label
            else:
                waiting.append(t)
                told[t] = settled
                if settled is None:  # nothing has lasted yet: all follow the last run
                    told.update(dict.fromkeys(waiting, label))
        self.at.update((settled, label, length))
        self.waiting.put([(t,) for t in waiting]) if waiting else self.waiting.clear()
        yield from told.items()


class Limiter(_InOrder):
    """Whether each request is admitted: fewer than ``limit`` of the ``width`` seconds before it were. Refused ones don't count."""

    def __init__(self, keys: list[str], limit: int, width: int, ttl: int | None):
        super().__init__(keys, {"event_id": "Int64", "admitted": "boolean"})
        self.limit, self.width, self.ttl = limit, width, ttl

    def open(self, handle):
        self.kept = handle.getListState("kept", "t long", self.ttl)

    def order(self):
        return ["t", "event_id"]

    def follow(self, rows):
        kept = [r[0] for r in self.kept.get()] if self.kept.exists() else []
        for t, event in zip(rows["t"], rows["event_id"], strict=True):
            kept = [k for k in kept if k > t - self.width]
            admitted = len(kept) < self.limit
            if admitted:
                kept.append(int(t))
            yield t, event, admitted
        self.kept.put([(t,) for t in kept]) if kept else self.kept.clear()


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, columns: str) -> DataFrame:
    fields = f"{_key_fields(rows, keys)}, t long, kind string, {columns}"
    mode = "none" if getattr(processor, "ttl", None) is None else "processingTime"
    return rows.groupBy(*keys).transformWithStateInPandas(processor, fields, "update", mode)


def fired_today(rows: DataFrame, keys: list[str], ttl: int | None = None) -> DataFrame:
    """(keys, t, kind, day) from (keys, t, wanted). ``ttl``: milliseconds after which an idle latch is forgotten; a stream with one never ends by itself, as there is always time to pass."""
    return _run(rows.select(*keys, "t", "wanted"), keys, Latch(keys, ttl), "day long")


def dwelling(rows: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """(keys, t, kind, state) from (keys, t, label)."""
    return _run(rows.select(*keys, "t", "label"), keys, Dwell(keys, least), "state long")


def limited(rows: DataFrame, keys: list[str], limit: int, width: int, ttl: int | None = None) -> DataFrame:
    """(keys, t, kind, event_id, admitted) from (keys, t, event_id)."""
    return _run(rows.select(*keys, "t", "event_id"), keys, Limiter(keys, limit, width, ttl), "event_id long, admitted boolean")


def on_time(told: DataFrame) -> DataFrame:
    return told.filter("kind = 'told'").drop("kind")


def late(told: DataFrame) -> DataFrame:
    """The side table: rows that came after newer ones of their key."""
    return told.filter("kind = 'late'").drop("kind")


def to_end(told: DataFrame, keys: list[str]) -> DataFrame:
    """``jobs.run_to_end`` with the state store that these operators need."""
    conf = told.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        return run_to_end(told, keys)
    finally:
        conf.set(PROVIDER, before)
