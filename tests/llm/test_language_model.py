from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import language_model
from stationlake.llm.common import remainder_of_id

BLANKS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*BLANKS.findall((text or "").translate(LOWER)), ""]


def brute_force(rows, train):
    """Counts of words, of pairs, of triples (the start of a text is None), their number, the different words, and the base."""
    count, pairs, contexts, triples = Counter(), Counter(), Counter(), Counter()
    for i, text in rows:
        if train(i):
            last = before = None
            for at, t in enumerate(tokens(text)):
                count[t] += 1
                pairs[last, t] += 1
                contexts[last] += 1
                if at:
                    triples[before, last, t] += 1
                before, last = last, t
    n, v = sum(count.values()), len(count)
    base = lambda t: (count[t] + 0.1) / (n + 0.1 * (v + 1))
    return count, pairs, contexts, triples, n, v, base


def strengths(count, pairs, triples):
    """The two k, from numbers of contexts by power of two."""
    found = []
    for inner, outer in ((count, pairs), (pairs, triples)):
        bins, sums = [0] * 48, [0] * 48
        for c in inner.values():
            bins[math.frexp(c)[1]] += 1
            sums[math.frexp(c)[1]] += c
        found.append(language_model.concentration(bins, sums, len(outer)) if outer else 1.0)
    return found


def probability(model, k2, k3, before, last, t, first):
    count, pairs, contexts, triples, n, v, base = model
    p = (pairs[last, t] + k2 * base(t)) / (contexts[last] + k2)
    return p if first else (triples[before, last, t] + k3 * p) / (pairs[before, last] + k3)


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = remainder_of_id("doc_id", 10)
    rows = docs.withColumn("fold", fold).collect()
    training = {r["doc_id"] for r in rows if r["fold"] != 0}
    model = brute_force([(r["doc_id"], r["text"]) for r in rows], training.__contains__)
    count, pairs, contexts, triples, n, v, base = model
    found = {r["doc_id"]: r for r in language_model.score(docs, fold != 0).collect()}
    assert found.keys() == {r["doc_id"] for r in rows}
    k2, k3 = strengths(count, pairs, triples)
    for r in rows:
        words, got = tokens(r["text"]), found[r["doc_id"]]
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(words), sum(count[t] > 0 for t in words), n)
        assert got["base_score"] == pytest.approx(sum(math.log10(base(t)) for t in words), rel=1e-9)
        want, before, last = 0.0, None, None
        for at, t in enumerate(words):
            want += math.log10(probability(model, k2, k3, before, last, t, not at))
            before, last = last, t
        assert got["score"] == pytest.approx(want, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    """The automaton's weights of all words after each context, with one share for unknown words."""
    texts = ["a b a b c", "b a", "c c a", "zzz a zzz"]
    block = language_model.Block([t.encode() for t in texts])
    learn = np.repeat([True, True, True, False], block.lengths)
    counts = block.counts(learn)
    n, v = counts[0].sum(), (counts[0] > 0).sum()
    automaton, start = language_model.build(block, counts, (counts[0] + 0.1) / (n + 0.1 * (v + 1)), 0.7, 1.3)
    symbols = np.arange(len(counts[0]))
    states = {-1, start, *automaton.targets.tolist(), *automaton.root_targets.tolist()}
    assert len(states) > 8
    for state in states:
        weight, _ = automaton.step(np.full(len(symbols), state), symbols)
        assert (10**weight).sum() == pytest.approx(1)


def test_state_is_carried(spark):
    """Stretches of a long text give what one walk gives, and the third word's weight depends on both words ahead."""
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice(list("abcde"), 300))
    block = language_model.Block([text.encode(), b"a b c", b"x b c", b""])
    counts = block.counts(np.ones(len(block.tokens), dtype=bool))
    automaton, start = language_model.build(block, counts, (counts[0] + 0.1) / (counts[0].sum() + 0.6), 0.5, 0.5)
    whole = language_model.traverse(automaton, block, start, stretch=1 << 20)
    for stretch in (3, 7, 64):
        assert language_model.traverse(automaton, block, start, stretch) == pytest.approx(whole)
    state, walked = np.array([start]), []
    for symbol in block.tokens[:301]:
        weight, state = automaton.step(state, np.array([symbol], dtype=np.int64))
        walked.append(weight[0])
    assert walked == pytest.approx(whole[:301])
    assert whole[303] != pytest.approx(whole[307])


def test_what_is_named_travels_whole():
    rng = np.random.default_rng(3)
    for size, top in ((1, 40), (5, 40), (4000, 40), (4000, 30), (0, 40)):
        keys = np.sort(rng.integers(0, 1 << top, size, dtype=np.uint64))
        assert size == 0 or language_model.unpack_keys(language_model.pack_keys(keys)).tolist() == keys.tolist()
        counts = rng.choice([0, 1, 2, 254, 255, 256, 1 << 40], size)
        assert language_model.unpack_counts(language_model.pack_counts(counts), size).tolist() == counts.tolist()


def test_rows_of_one_id_are_no_block(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('word ', id) as text")
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.spark_partition_id()), F.lit(62))
    assert docs.groupBy(block).count().agg(F.max("count")).first()[0] < 150
    assert language_model.score(docs, F.lit(True)).count() == 4000


def test_better_than_base_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = remainder_of_id("doc_id", 10)
    held = language_model.score(docs, fold != 0).filter(fold == 0).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "word " * 30_000, "w")], "doc_id long, text string, block string"
    ).withColumn("slot", F.lit(1)).withColumn("counts", F.lit(2))
    got = language_model.score(docs, F.lit(True)).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got) == [1, 1, 1, 3, 30_001]
    assert {r["train_tokens"] for r in got} == {30_007}
    untrained = language_model.score(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["score"] == pytest.approx(r["base_score"]) for r in untrained)
    assert language_model.score(docs.limit(0), F.lit(True)).count() == 0
