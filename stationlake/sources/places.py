"""Weather of many places as a Spark data source: places are asked for in batches, and a bounded number of batches at a time.

    places.register(spark)
    spark.read.format("place_weather").option("fetch", "package.module:function").option("places", '[["a", -1.1, 37.0], ...]').option("start", 0).option("end", 86400).load()

``fetch(places, start, end)``, with places as (place, lat, lng), returns for each of them, in their order, a list of (t, channel, value), or null where it has nothing. A batch that
fails, or comes back with another number of places, gives one row a place with nulls in t, channel and value, as does a place that has nothing: what is missing
can be told and counts against the coverage of its area. Filters on ``place`` and ``t`` narrow what is asked for; Spark pushes them down only where
``spark.sql.python.filterPushdown.enabled`` is on, which ``register`` sees to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Places in a request, requests at a time.
BATCH, IN_FLIGHT = 40, 4


class Batches(InputPartition):
    def __init__(self, batches: list[list[tuple]], start: int, end: int):
        self.batches, self.start, self.end = batches, start, end


class PlaceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch = options["fetch"]
        self.places = [tuple(p) for p in json.loads(options["places"])]
        self.start, self.end = int(options["start"]), int(options["end"])
        self.batch, self.in_flight = int(options.get("batch", BATCH)), int(options.get("in_flight", IN_FLIGHT))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows places and times. Filters on times stay with Spark, too, which drops the rows without one."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "place" and isinstance(f, EqualTo):
                self.places = [p for p in self.places if p[0] == f.value]
            elif column == "place" and isinstance(f, In):
                self.places = [p for p in self.places if p[0] in set(f.value)]
            else:
                if column == "t" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, f.value + isinstance(f, GreaterThan))
                elif column == "t" and isinstance(f, (LessThan, LessThanOrEqual)):
                    self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
                yield f

    def partitions(self) -> list[Batches]:
        """As many partitions as requests may be in flight: a partition asks for its batches one after the other."""
        batches = [self.places[i : i + self.batch] for i in range(0, len(self.places), self.batch)]
        return [Batches(batches[k :: self.in_flight], self.start, self.end) for k in range(min(self.in_flight, len(batches)))]

    def read(self, partition: Batches) -> Iterator[tuple]:
        if partition is None:  # Spark's stand-in where there are no places
            return
        module, name = self.fetch.split(":")
        fetch = getattr(import_module(module), name)
        for batch in partition.batches:
            try:
                found = list(fetch(batch, partition.start, partition.end))
                if len(found) != len(batch):
                    raise ValueError(f"asked for {len(batch)} places, got {len(found)}")
            except Exception:
                found = [None] * len(batch)
            for (place, lat, lng), rows in zip(batch, found, strict=True):
                if not rows:
                    yield place, lat, lng, None, None, None
                for t, channel, value in rows or ():
                    if partition.start <= t < partition.end:
                        yield place, lat, lng, t, channel, value


class PlaceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "place_weather"

    def schema(self) -> str:
        return "place string, lat double, lng double, t long, channel string, value double"

    def reader(self, schema) -> PlaceReader:
        return PlaceReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlaceSource)
