from __future__ import annotations

import glob
import gzip
import hashlib
import tempfile
from collections import defaultdict

import pytest

from oracle import compare, connect
from stationlake.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def plain(rows):
    """(page_id, bytes, digest, type, refers_to)"""
    of = defaultdict(list)
    data = [(i, (h or "").encode()) for i, _, h in rows]
    for i, payload in data:
        of[payload].append(i)
    found = []
    for i, payload in data:
        ids = [x for x in of[payload] if x is not None]
        best = max(ids) if ids and len(payload) >= 1000 else None
        revisit = best is not None and i != best
        found.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(found, key=repr)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


LONG = "<p>ä" * 400


def test_query_matches_sql(spark, sf_dir):
    df = queries.op13_warc(spark, sf_dir)
    compare(df.collect(), df.columns, connect(sf_dir).sql(queries.oracle_sql()["op13_warc"]))


@pytest.mark.parametrize("archive_bytes", [1 << 30, 500])
def test_copies_are_revisits(spark, archive_bytes):
    rows = [(i, f"http://Host{i % 7}.example.org:80/p/{i}?q#f", LONG if i % 3 else f"page {i}") for i in range(90)]
    rows += [(100, None, None), (101, "", ""), (None, "x y\nz", LONG), (89, "http://a.b/", LONG), (102, "http://[::1", "\r\n\r\n" * 300), (103, "http://a.b/", "\r\n\r\n" * 300)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "'x' as digest", "2 as refers_to", "3 as offset").repartition(4)
    assert got(warc.round_trip(pages, archive_bytes=archive_bytes)) == plain(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(empty).count() == 0
    no_ids = [(None, "http://a/", LONG), (None, "http://a/", LONG), (5, "http://a/", LONG * 300), (5, "http://a/", LONG * 300)]
    assert got(warc.round_trip(spark.createDataFrame(no_ids, SCHEMA))) == plain(no_ids)


def test_archives_are_members_of_whole_records(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-")
    rows = [(i, f"https://example.org/{i}", f"<p>{i}") for i in range(20)]
    captures = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), folder).collect()
    for c in captures:
        data = open(f"{folder[7:]}/{c['file']}", "rb").read()[c["offset"] : c["offset"] + c["length"]]
        found = warc.parsed(gzip.decompress(data))
        assert (found["page_id"], found["payload"].decode(), found["url"]) == (c["page_id"], f"<p>{c['page_id']}", f"https://example.org/{c['page_id']}")
    whole = b"".join(gzip.open(f, "rb").read() for f in glob.glob(f"{folder[7:]}/*.warc.gz"))
    assert whole.count(b"WARC/1.0\r\n") == 20


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_lookup_equals_a_scan(spark, lines):
    """Keys over several shards and blocks, keys before, between and after all, and one that a third of all captures have."""
    folder = "file://" + tempfile.mkdtemp(prefix="warc-")
    url = lambda i: "http://hot.example.org/" if i % 3 == 0 else f"http://h{i % 11}.example.org/{i % 40}"
    rows = [(i, url(i), f"<p>{i}") for i in range(200)]
    captures = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{folder}/a").persist()
    shards = warc.write_index(captures, f"{folder}/i", lines_per_block=lines).persist()
    assert shards.count() > 1
    asked = [url(i) for i in range(0, 30)] + ["http://a.example.com/", "http://zz.zz/", "http://hot.example.org/x", None, "https://HOT.example.org:443/#top"]
    found = warc.lookup(shards, f"{folder}/i", spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    want = {(u, str(i)) for u in set(asked) for i, v, _ in rows if warc.key_of(u) == warc.key_of(v)}
    assert {(r["url"], r["page_id"]) for r in found} == want and len(found) == len(want)
    pieces = warc.read_back(warc.all_captures(shards, f"{folder}/i"), f"{folder}/a", piece_bytes=300, read_bytes=500).collect()
    assert sorted((int(r["page_id"]), r["payload"].decode()) for r in pieces) == [(i, h) for i, _, h in rows]


def test_damaged_payload_is_an_error():
    data = warc.record(1, "http://a/", b"abc", 3, hashlib.sha1(b"abc").hexdigest())
    assert warc.parsed(data)["payload"] == b"abc"
    with pytest.raises(ValueError, match="payload"):
        warc.parsed(data.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="end"):
        warc.parsed(data[:-4])


def test_keys():
    assert warc.key_of("HTTP://www.Example.com:80/a b?x=1#y") == "com,example,www)/a%20b?x=1"
    assert warc.key_of("https://example.com:8443") == "com,example:8443)/"
    assert warc.key_of("mailto:x") == "mailto:x" and warc.key_of(None) == ""


def test_round_trip_goes_by_the_index(spark, monkeypatch):
    """Each page is found by its URL's key; a capture comes once where URLs share a key, also if none of them is known or one has very many."""
    monkeypatch.setattr(warc, "all_captures", None)
    urls = ["http://a.org/", "HTTP://A.org:80/#x", "http://a.org/b", None, "", "mailto:x", "http://a.org/b c", "http://a.org/b%20c"]
    rows = [(i, urls[i % 8], f"{i}" if i % 2 else LONG) for i in range(70)] + [(100 + i, "http://hot.org/", f"hot {i}") for i in range(60)]
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got(found) == plain(rows)


def test_search_holds_few_captures(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="warc-")
    rows = [(i, "http://hot.org/" if i % 4 else f"http://a.org/{i}", f"<p>{i}") for i in range(200)]
    shards = warc.write_index(warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"{folder}/a"), f"{folder}/i", lines_per_block=7).persist()
    found = warc._search(shards, f"{folder}/i", warc._keys(spark.createDataFrame(rows, SCHEMA), "url"), most=5).collect()
    assert sorted((int(r["page_id"]), r["url"]) for r in found) == [(i, u) for i, u, _ in rows]
