from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import compare, connect
from stationlake.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n, buckets, percent, least_words, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in features_of(text, n))
    t = Counter(bucket(f) for text in target for f in features_of(text, n))
    gain = {
        b: math.floor(1000 * math.log(float(t[b] + 1) * (s.total() + buckets) / (float(s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)
    }
    rows = []
    for at, (id_, text) in enumerate(docs):
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        found = features_of(text, n)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([at, id_, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if len(words_of(docs[r[0]][1])) >= least_words), key=lambda r: (-r[4], r[1] is None, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted((tuple(r[1:]) for r in rows), key=repr)


def found(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("chunk_bytes", [1 << 16, 50])
def test_equals_a_plain_version(spark, n, chunk_bytes):
    docs = [(i, " ".join(f"w{(i * j) % 23} É{j % 5}x," for j in range(i * 3 % 40))) for i in range(60)] + [(60, "Long " * 400)]
    target = ["w3 w5 w7 long long", None, "", "w1 É2x"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, other, n=n, buckets=50, percent=30, least_words=5, chunk_bytes=chunk_bytes)
    assert found(got.collect()) == plain(docs, target, n, 50, 30, 5)


def test_query_matches_sql(spark, sf_dir):
    got = queries.op12_resampling(spark, sf_dir)
    compare(got.collect(), got.columns, connect(sf_dir).sql(queries.oracle_sql()["op12_resampling"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", " ", "  ", "d" * 30]), max_size=40).map("".join), st.integers(1, 20), st.integers(1, 4))
def test_chunks_own_each_start_once(text, size, n):
    of = resampling._Buckets(n, 1_000_003)
    whole = of.of_chunk(text.encode(), b"")
    parts = [of.of_chunk(*part) for part in resampling.cut(text.encode(), size, n - 1)]
    assert sum(w for w, _ in parts) == whole[0]
    assert sorted(b for _, part in parts for b in part) == sorted(whole[1])


def test_edges(spark):
    text = "one two three four five"
    docs = [(1, None), (2, ""), (3, "?!"), (None, text), (None, text), (4, text), (4, text), (4, text + " six"), (5, "x" * 300_000), (6, "Ünï " * 50_000)]
    frame = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in docs], "doc_id long, text string, score int, rank int, key int")
    other = spark.createDataFrame([("five six",)], "text string")
    got = found(resampling.resample(frame, other, percent=100, least_words=5, chunk_bytes=1000).collect())
    want = plain(docs, ["five six"], 1, 10_000, 100, 5)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4, 5, 6]
    assert {r for r in got if r[0] == 4} == {r for r in want if r[0] == 4}
    assert resampling.resample(frame.limit(0), other).count() == 0
    assert {r["rank"] for r in resampling.resample(frame, other.limit(0), percent=1, least_words=1).collect()} == {None}


def test_ranks_of_copies_are_places_among_all_rows(spark):
    rows = spark.createDataFrame([(i, 1 + i % 7) for i in range(200)], "i int, copies long").repartition(6)
    got = resampling.numbered(rows, "copies", rows["i"].desc()).collect()
    before = 0
    for r in sorted(got, key=lambda r: -r["i"]):
        assert r["before"] == before
        before += r["copies"]
    assert {r["total"] for r in got} == {before}
