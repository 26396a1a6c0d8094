"""A streaming source whose newest window fills late."""

from __future__ import annotations

import json


import pytest

import feed_stub
from stationlake.sources import windows


@pytest.fixture
def feed(spark, tmp_path):
    state = feed_stub.STATE
    (tmp_path / "log").touch()
    spark.dataSource.register(windows.WindowFeed)

    def run(at: int):
        """Runs the stream to its end at a time; the windows asked for, and all that the sink holds."""
        state.write_text(json.dumps({"now": at, "log": str(tmp_path / "log")}))
        before = (tmp_path / "log").read_text().count("\n")
        stream = spark.readStream.format("station_windows").options(fetch="tests.feed_stub:late", clock="tests.feed_stub:now", start=0, width=3600, grace=900).load()
        job = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        job.awaitTermination()
        asked = [int(x) // 3600 for x in (tmp_path / "log").read_text().split()][before:]
        rows = windows.newest(spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))).collect()
        return sorted(asked), {r["t"]: r["value"] for r in rows}

    return run


def test_the_open_window_is_offered_until_it_is_complete(feed):
    asked, rows = feed(3000)
    assert asked == [0] and rows[2400] == 2400 and rows[2700] == 0
    asked, rows = feed(4000)  # the first window has ended, but may still change; the next has begun
    assert asked == [0, 1] and rows[2700] == 2700 and rows[3600] == 0
    asked, rows = feed(4600)  # the first is read for the last time
    assert asked == [0, 1] and rows[3300] == 3300 and rows[3900] == 3900
    asked, rows = feed(12_000)
    assert asked == [1, 2, 3] and rows[11_400] == 11_400 and rows[11_700] == 0
    assert sorted(rows) == list(range(0, 12_001, 300))


def test_offsets():
    r = windows.WindowReader({"fetch": "x:y", "start": "7200", "width": "3600", "grace": "900"})
    assert r.initialOffset() == {"open": 2, "read": 0}
    spans = lambda a, b: [w.start // 3600 for w in r.partitions(a, b)]
    assert spans({"open": 2, "read": 0}, {"open": 2, "read": 7500}) == [2]
    assert spans({"open": 2, "read": 7500}, {"open": 5, "read": 19_000}) == [2, 3, 4, 5]
