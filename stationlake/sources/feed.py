"""A REST feed as a Spark data source: a partition for each stretch of time, read by the executors.

    spark.dataSource.register(FeedSource)
    spark.read.format("station_feed").option("fetch", "package.module:function").option("start", 0).option("end", 86400).load()

``fetch(start, end)`` returns a list of (t, channel, value). A stretch that fails is read again as any task is, and at last fails the job; with
``skip_failed`` true it is tried once and then gives one row, its start on the channel ``failed_stretch``, so that what is missing can be told.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


FAILED = "failed_stretch"


class Stretch(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch = options["fetch"]
        self.start, self.end = int(options["start"]), int(options["end"])
        self.width = int(options.get("width", 28 * 86400))
        self.skip = str(options.get("skip_failed", "false")).lower() == "true"

    def partitions(self) -> list[Stretch]:
        return [Stretch(a, min(a + self.width, self.end)) for a in range(self.start, self.end, self.width)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        module, name = self.fetch.split(":")
        fetch = getattr(import_module(module), name)
        try:
            rows = fetch(partition.start, partition.end)
        except Exception:
            if not self.skip:
                raise
            rows = [(partition.start, FAILED, None)]
        for t, channel, value in rows:
            if partition.start <= t < partition.end:
                yield t, channel, value


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "station_feed"

    def schema(self) -> str:
        return "t long, channel string, value double"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def pivoted(feed: DataFrame, channels: list[str], keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """One row for each time with a column for each channel; of several values the last in order counts."""
    return feed.groupBy(*keys).pivot("channel", channels).agg(F.max("value"))
