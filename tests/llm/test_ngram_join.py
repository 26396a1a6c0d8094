from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stationlake.llm import ngram_join
from stationlake.llm.components import components


def grams(text, n=5):
    words = ngram_join.WORDS.findall((text or "").lower())
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_force(rows, threshold=0.8):
    """id -> (class, copy, copies, links) by comparing all different texts."""
    words = {i: tuple(ngram_join.WORDS.findall((t or "").lower())) for i, t in rows}
    copies = defaultdict(list)
    for i, w in words.items():
        copies[w if w else ("", i)].append(i)
    reps = {k: min(v) for k, v in copies.items()}
    sets = {reps[k]: grams(" ".join(k)) for k in copies if k[:1] != ("",)}
    parent, links = {r: r for r in reps.values()}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for at, a in enumerate(names):
        for b in names[at + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(reps[k]), reps[k], len(v), links[reps[k]]) for k, v in copies.items() for i in v}


def joined(docs, **options):
    return {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_copies"], r["n_links"]) for r in ngram_join.join(docs, **options).collect()}


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert joined(docs) == want
    assert any(v[3] for v in want.values())


def near_copies(count, seed=3, size=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
    texts = []
    for i in range(count):
        words = list(base)
        words[rng.randrange(size)] = f"x{i}"
        texts.append(" ".join(words))
    return texts


def test_large_groups_go_in_pieces(spark):
    """More near copies than a piece holds: links across chunks are found and counted once."""
    rows = list(enumerate(near_copies(700)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs) == brute_force(rows)


def test_prefix_length_meets_recall():
    for trees in (8, 32, 64):
        d = ngram_join.depth(trees, 0.8, 0.999)
        assert d == 1 or 1 - (1 - 0.8**d) ** trees >= 0.999
        assert d == ngram_join.LEVELS or 1 - (1 - 0.8 ** (d + 1)) ** trees < 0.999


def test_dense_texts_stop_at_longer_prefixes(spark):
    """A crowd below one short prefix keeps the long one; a pair that shares only the short one meets there."""
    crowd = [(i, 7 << 56 | 5 << 8 | i % 2) for i in range(40)]
    pair = [(100, 3 << 56 | 9 << 8 | 1), (101, 3 << 56 | 9 << 8 | 2), (102, 3 << 56 | 10 << 8 | 2)]
    found = ngram_join.stops(spark.createDataFrame(crowd + pair, "node long, label long"), 7, 6, few=8).collect()
    depths = {r["node"]: r["depth"] for r in found}
    assert depths == {**{i: 7 for i in range(40)}, 100: 6, 101: 6}
    leaf = {r["node"]: r["leaf"] for r in found}
    assert leaf[0] == leaf[2] != leaf[1] and leaf[100] == leaf[101]


def test_chains_go_node_by_node(spark):
    """Texts that share much with the next ones only: the group is large, and far pairs are not compared together."""
    rng = random.Random(5)
    stream = [f"w{rng.randrange(10_000)}" for _ in range(700)]
    rows = [(i, " ".join(stream[4 * i : 4 * i + 80])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert want[0][3] and max(v[3] for v in want.values()) < 10
    assert joined(docs, whole=8, chunk_texts=16) == want
    assert joined(docs, whole=8, few=2) == want


def test_pieces_have_a_fixed_size(spark):
    rows = list(enumerate(near_copies(300)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert joined(docs, whole=8, chunk_texts=50) == want
    assert joined(docs, whole=8, chunk_grams=2000) == want


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(12)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert ngram_join.common_counts(sets).tolist() == want
    assert ngram_join.common_counts(sets[:2]).tolist() == [r[:2] for r in want[:2]]


def test_edges(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None, "a"), (2, "", "b"), (3, "?!", "c"), (5, text, "d"), (4, text.upper() + "!", "e"), (6, "one two", "f"), (7, "One, two", "g"), (8, "w " * 100_000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("*", "1 as key", "2 as label", "3 as class_id")
    got = joined(docs)
    assert got == {1: (1, 1, 1, 0), 2: (2, 2, 1, 0), 3: (3, 3, 1, 0), 4: (4, 4, 2, 0), 5: (4, 4, 2, 0), 6: (6, 6, 2, 0), 7: (6, 6, 2, 0), 8: (8, 8, 1, 0)}
    assert ngram_join.join(docs.limit(0)).count() == 0
    twice = docs.filter("doc_id = 5").union(docs.filter("doc_id = 5"))
    assert [(r["class_id"], r["n_copies"], r["n_links"]) for r in ngram_join.join(twice).collect()] == [(5, 2, 0)] * 2


@pytest.mark.parametrize("seed", range(3))
def test_components_match_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(100)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["label"] for r in got.collect()} == {n: find(n) for n in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
