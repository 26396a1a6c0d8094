from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.llm import mtree, rp_forest


def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)


def exact(ids, scores, query, top, highest):
    keep = ids != query
    by = np.lexsort((ids[keep], -scores[keep] if highest else scores[keep]))[:top]
    return ids[keep][by].tolist(), scores[keep][by].tolist()


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("shard", [8192, 100])
def test_products_match_brute_force(spark, sf_dir, shard):
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ids, x = vectors(spark, sf_dir)
    whole = np.floor(1024 * x)
    got = by_query(mtree.top_products(docs, F.col("id") % 10 == 0, rows_per_shard=shard))
    assert got.keys() == {int(i) for i in ids if i % 10 == 0}
    for q, found in got.items():
        names, scores = exact(ids, whole @ whole[ids == q][0], q, 10, True)
        assert [n for _, n, _ in found] == names and [s for *_, s in found] == scores
        assert [r for r, *_ in found] == list(range(1, 11))


@pytest.mark.parametrize("page", [8, 64])
def test_tree_is_exact_and_avoids_distances(monkeypatch, page):
    import pyarrow as pa

    monkeypatch.setattr(mtree, "PAGE", page)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (20, 16))
    rows = np.floor(centres[rng.integers(20, size=3000)] + rng.normal(0, 20, (3000, 16)))
    ids = np.arange(3000)
    blank = dict.fromkeys(["page", "leaf", "ids", "objects", "radii", "to_parent", "children"])
    tree = mtree.Tree(pa.Table.from_pylist([blank | p for p in mtree.build(ids, rows)]), 16)
    for q in range(0, 3000, 100):
        names, scores = tree.nearest(q, rows[q], 10)
        want = exact(ids, rows @ rows[q], q, 10, True)
        assert (names.tolist(), scores.tolist()) == want
    assert tree.avoided > 0
    if page == 8:
        assert tree.computed < 0.4 * 30 * 3000


def test_forest_recall_and_distances(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ids, x = vectors(spark, sf_dir)
    got = by_query(rp_forest.nearest_rows(docs, F.col("id") % 10 == 0))
    hits = total = 0
    for q, found in got.items():
        distances = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        names, _ = exact(ids, distances, q, 10, False)
        hits += len({n for _, n, _ in found} & set(names))
        total += len(names)
        assert [s for *_, s in found] == sorted(s for *_, s in found)
        for _, n, s in found:
            assert s == pytest.approx(distances[ids == n][0], rel=1e-12)
    assert hits / total >= 0.9


def clustered(spark, rows=2000, clusters=20):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (clusters, 16))
    x = (centres[rng.integers(clusters, size=rows)] + rng.normal(0, 0.02, (rows, 16))).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), x.astype(float)


@pytest.mark.parametrize("kind", ["mtree", "forest"])
def test_regions_are_left_out(spark, kind):
    """Of clustered rows a query meets a small part of the regions, and still gets what all rows give."""
    docs, x = clustered(spark)
    search, visits = (mtree.top_products if kind == "mtree" else rp_forest.nearest_rows), []
    got = by_query(search(docs, F.col("id") % 20 == 0, rows_per_region=50, visits=visits))
    met = sum(v.count() for v in visits)
    assert len(visits) == 2 and 100 <= met < 0.35 * 100 * 40
    ids, whole = np.arange(len(x)), np.floor(1024 * x)
    for q, found in got.items():
        scores = whole @ whole[q] if kind == "mtree" else np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        names, _ = exact(ids, scores, q, 10, kind == "mtree")
        assert [n for _, n, _ in found] == names


def test_regions_without_structure(spark):
    """Independent components: all regions are met, nothing is lost; a length that the sample has missed is a region, too."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (900, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, [1.0, 2.0, 3.0]), (10_001, [1.0, 2.0, 2.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = by_query(mtree.top_products(docs, F.col("id") % 50 == 0, rows_per_region=100, rows_per_shard=40, queries_per_block=3))
    whole = np.floor(1024 * x.astype(float))
    assert len(got) == 19 and [n for _, n, _ in got[10_000]] == [10_001]
    for q in range(0, 900, 50):
        names, scores = exact(np.arange(900), whole @ whole[q], q, 10, True)
        assert [(n, s) for _, n, s in got[q]] == list(zip(names, scores))


@pytest.mark.parametrize("count", [3000, 8192])
def test_forest_recall_at_its_share(count):
    """Vectors of unit length without structure: the default share, below half of the rows, holds nine tenths of the neighbours."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (count, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    trees = [{"ids": [], "tree": t} | rp_forest.grow(x, 32, np.random.default_rng(t)) for t in range(32)]
    blank = {"ids": [], "limits": [], "sides": [], "leaves": b"", "leaf_starts": []}
    forest = rp_forest.Forest(pa.Table.from_pylist([blank | {"tree": -1, "ids": list(range(count)), "normals": x.tobytes()}, *trees]), 64)
    hits = 0
    for q in range(40):
        names, _ = forest.nearest(q, x[q], 10, int(0.4 * count))
        want, _ = exact(np.arange(count), ((x - x[q]) ** 2).sum(axis=1), q, 10, False)
        hits += len(set(names.tolist()) & set(want))
    assert hits >= 0.9 * 400


def test_forest_leaves_stay_small():
    same = np.ones((1000, 4))
    tree = rp_forest.grow(same, 64, np.random.default_rng(0))
    assert max(np.diff(tree["leaf_starts"])) <= 64
    assert sorted(np.frombuffer(tree["leaves"], dtype=np.int32)) == list(range(1000))


@pytest.mark.parametrize("search", [lambda d: mtree.top_products(d, F.col("id") % 100 == 0), lambda d: rp_forest.nearest_rows(d, F.col("id") % 100 == 0)])
def test_edges(spark, search):
    schema = "vec_id long, embedding array<float>, shard string, block string, id string, vec string"
    extra = ("s", "b", "i", "v")
    rows = [
        (0, [1.0, 2.0], *extra),
        (100, None, *extra),
        (200, [], *extra),
        (300, [1.0, None], *extra),
        (400, [math.nan, 1.0], *extra),
        (500, [math.inf, 1.0], *extra),
        (None, [1.0, 1.0], *extra),
        (7, [3.0, 4.0, 5.0], *extra),
        *[(i, [1.0, 2.0], *extra) for i in range(20, 0, -1)],
        (0, [1.0, 2.0], *extra),
    ]
    got = by_query(search(spark.createDataFrame(rows, schema)))
    assert got.keys() == {0} and [n for _, n, _ in got[0]] == list(range(1, 11))
    alone = by_query(search(spark.createDataFrame([(0, [1.0, 2.0], *extra), (3, [0.5, 0.25], *extra)], schema)))
    assert [(r, n) for r, n, _ in alone[0]] == [(1, 3)]
    assert search(spark.createDataFrame([], schema)).count() == 0
