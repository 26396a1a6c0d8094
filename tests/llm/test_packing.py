from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stationlake.llm import packing

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def check(pieces, texts, capacity=1024):
    """Each id in exactly one piece, sequences gapless and within capacity; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == texts.keys()
    for doc, found in by_doc.items():
        ids = TOKENIZER.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(found, key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p["length"]
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    used = sum(p["length"] for p in pieces)
    return 1 - used / (capacity * len(by_sequence))


def test_query_holds_every_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check(packing.pack(docs, RANKS, PATTERN).collect(), texts) < 0.02


def test_many_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check(packing.pack(docs, RANKS, PATTERN, docs_per_group=20).collect(), texts) < 0.2


def largest_first(sizes, windows):
    """Plain Karmarkar-Karp: partial partitions of one item each, merged by largest imbalance, heaviest with lightest."""
    parts = [[s] + [0] * (windows - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p) - min(p))
        a, b = sorted(parts.pop(), reverse=True), sorted(parts.pop())
        parts.append([x + y for x, y in zip(a, b, strict=True)])
    return max(parts[0])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 128), min_size=1, max_size=60), st.integers(1, 6))
def test_differencing_balances(sizes, windows):
    window, loads = packing.difference(np.array(sizes), windows)
    assert np.bincount(window, weights=sizes, minlength=windows).tolist() == loads.tolist()
    assert sum(loads) == sum(sizes)
    assert loads.max() <= max(largest_first(sizes, windows) * 4 / 3 + 1, max(sizes))


def test_windows_rise_with_need():
    sizes = np.array([600, 600, 600])
    window = packing.spread(sizes, 1024)
    assert len(set(window.tolist())) == 3


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "no id", 3), (3, "x " * 20_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").selectExpr("*", "1 as start", "2 as `group`")
    assert check(packing.pack(docs, RANKS, PATTERN).collect(), {r[0]: r[1] for r in rows}) >= 0
    twice = docs.filter("doc_id = 3").union(docs.filter("doc_id = 3"))
    pieces = packing.pack(twice, RANKS, PATTERN).collect()
    assert sum(p["length"] for p in pieces) == 2 * pieces[0]["doc_tokens"]
    assert packing.pack(docs.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("tokens", [1024, 1023, 1025, 2048])
def test_full_windows(spark, tokens):
    text = " a" * (tokens - 1)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    check(packing.pack(docs, RANKS, PATTERN).collect(), {1: text})


def test_rows_of_one_id_are_dealt_out(spark):
    docs = spark.range(50_000).selectExpr("cast(null as long) as doc_id", "'a few words' as text")
    pieces = packing.pack(docs, RANKS, PATTERN)
    assert pieces.count() == 50_000
    largest = pieces.groupBy((pieces["sequence_id"] / (1 << 32)).cast("long")).count().agg({"count": "max"}).first()[0]
    assert largest < 1300
