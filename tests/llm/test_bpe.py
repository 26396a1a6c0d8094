from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stationlake.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.PartEncoder(bpe.serialise_model(RANKS), public_tokenizers.PATTERN)


def ids(encoder, text):
    return list(memoryview(encoder.ids([text])[0]).cast("I"))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \t\n\r\x0b\x1c\x85\xa0 　'stmdé1²Ⅷ中😀.-", max_size=40))
def test_same_ids_as_the_library(encoder, text):
    found = ids(encoder, text)
    assert found == ENCODING.encode_ordinary(text)
    decoder = bpe.Decoder(RANKS)
    import numpy as np

    assert decoder.bytes(np.array(found, dtype=np.int64)) == text.encode()


def test_every_byte_string_of_the_vocabulary(encoder):
    texts = [t for r in RANKS if (t := r.decode("utf-8", "ignore")).encode() == r]
    for text, found in zip(texts, encoder.ids(texts), strict=True):
        assert list(memoryview(found).cast("I")) == ENCODING.encode_ordinary(text)


def test_query_matches_library(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op4_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        want = ENCODING.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_decode_alone(spark):
    docs = spark.createDataFrame([(1, "Some text, ünd mehr"), (2, None), (3, "")], "doc_id long, text string")
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    back = bpe.decode(encoded.union(spark.createDataFrame([(4, None)], encoded.schema)), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert {r["doc_id"]: r["decoded"] and bytes(r["decoded"]).decode() for r in back.collect()} == {1: "Some text, ünd mehr", 2: bytearray(), 3: bytearray(), 4: None}


def test_edges(spark):
    long = "a" * 50_000 + " word" * 50_000 + "\n" * 5_000
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (2, "twice", 1), (2, "twice", 1), (None, long, 1)], "doc_id long, text string, ids int")
    got = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(len(r["ids"]) for r in got) == sorted(map(len, map(ENCODING.encode_ordinary, ["", "", "twice", "twice", long])))
    assert bytes(next(r for r in got if r["doc_id"] is None)["decoded"]).decode() == long
    assert bpe.encode(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})
