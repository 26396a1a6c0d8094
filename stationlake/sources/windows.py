"""A feed of windows as a streaming source, whose newest window is offered again until it is complete.

    spark.dataSource.register(WindowFeed)
    spark.readStream.format("station_windows").option("fetch", "package.module:function").option("clock", "package.module:now").option("start", 0).load()

``fetch(start, end)`` returns a list of (t, channel, value), ``clock()`` the time in epoch seconds (the machine's, if it isn't named). A window is complete ``grace`` seconds after its end, as
data come a little late; until then each batch reads it anew. The offset is the first window that isn't complete, and how often it was offered: a batch reads the windows that were
completed since, once and for good, and the open one as it stands. A window read again brings all its rows again with a higher ``read``; of a (t, channel) the row of the highest one counts
(``newest``). A batch that is repeated after a failure asks for the same windows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: The length of a window, and how long after its end it may still change (s).
WIDTH, GRACE = 10800, 900


def _named(spec: str):
    module, name = spec.split(":")
    return getattr(import_module(module), name)


class Window(InputPartition):
    def __init__(self, start: int, end: int, read: int):
        self.start, self.end, self.read = start, end, read


class WindowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.fetch = options["fetch"]
        self.clock = options.get("clock")
        self.width, self.grace = int(options.get("width", WIDTH)), int(options.get("grace", GRACE))
        self.first = int(options["start"]) // self.width

    def _now(self) -> int:
        return int(_named(self.clock)() if self.clock else time.time())

    def initialOffset(self) -> dict:
        return {"open": self.first, "read": 0}

    def latestOffset(self) -> dict:
        """The window that is open now, and a number that grows with time, so that there is something to read as long as it is open."""
        now = self._now()
        return {"open": max(self.first, (now - self.grace) // self.width), "read": now}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        """The windows that were completed since ``start``, then the open ones: the one after the last complete window, and the next, if that has begun within the grace of the first."""
        upto = max(end["open"], end["read"] // self.width)
        return [Window(w * self.width, (w + 1) * self.width, end["read"]) for w in range(start["open"], upto + 1)]

    def read(self, partition: Window) -> Iterator[tuple]:
        fetch = _named(self.fetch)
        for t, channel, value in fetch(partition.start, partition.end):
            if partition.start <= t < partition.end:
                yield t, channel, value, partition.read

    def commit(self, end: dict) -> None:
        pass


class WindowFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "station_windows"

    def schema(self) -> str:
        return "t long, channel string, value double, read long"

    def streamReader(self, schema) -> WindowReader:
        return WindowReader(self.options)


def newest(rows: DataFrame) -> DataFrame:
    """(t, channel, value) by the last reading of each."""
    return rows.groupBy("t", "channel").agg(F.max_by("value", "read").alias("value"))
