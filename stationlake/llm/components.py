"""Connected components of an undirected graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for each node of ``edges`` (u, v), labelled with the least node of its component.

    Each round hooks every vertex to its least neighbour, shortens the chains that this makes, and contracts the edges
    to the new vertices; a round at least halves the vertices that still have edges. Labels and edges are written
    out each round, so a lost executor costs a round at most. A vertex with very many neighbours is met by sums with partial results and by joins,
    which Spark splits where they are skewed."""
    edges = settle(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        parents = settle(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), f"{name}-parents")
        for _ in range(2):
            up = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            shorter = settle(parents.join(up, "p").select("u", F.col("pp").alias("p")), f"{name}-parents")
            release(parents)
            parents = shorter
        if labels is None:
            relabelled = settle(parents.select(F.col("u").alias("node"), F.col("p").alias("label")), f"{name}-labels")
        else:
            moved = parents.select(F.col("u").alias("label"), "p")
            moved = labels.join(moved, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
            relabelled = settle(moved, f"{name}-labels")
            release(labels)
        labels = relabelled
        pu, pv = parents.select("u", F.col("p").alias("pu")), parents.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(pu, "u").join(pv, "v").filter("pu <> pv")
        contracted = settle(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), f"{name}-edges")
        release(edges, parents)
        edges = contracted
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
