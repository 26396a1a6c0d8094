"""What the two searches over vectors share: shards of bounded size, an index for each, and blocks of queries.

A bounded sample of rows, ``most_regions`` at most, are routing objects; each row belongs to the region of the nearest one, and each
region has a radius that covers its rows. A region is cut into shards of bounded size by a hash of the id; each shard's index
is built in one task and stored as a table. A query meets its most promising region first, and then only those regions whose
bound, by routing object and radius, isn't worse than the worst row that it has kept. On clustered rows that leaves few; rows
without structure leave all, a stated query set against all rows. Tables of a few thousand rows are one region.
Queries are sent, in blocks, to the shards they meet, and a shard goes to the blocks that meet it. Of equal vectors only the
``top + 1`` smallest ids can be among the results of any query, so the others are left out before anything is shuffled: the
limit runs in each task first, and a vector that a third of the rows hold stays cheap. Vectors of another length than the
query's never meet it.

Defined results: a null id takes no part, nor does a vector that is null, empty, or holds a null or non-finite component; a query's own id is left
out of its candidates; a repeated row, of the same id and vector, counts once and is answered once; rows that share an id but not the
vector are rows of their own; no rows give no results; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release, settle


def finite(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec array<double>, dim) of the rows that take part."""
    vec = F.col(vector_col).cast("array<double>")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter("id is not null and size(vec) > 0")
    return kept.filter(F.forall("vec", good)).withColumn("dim", F.size("vec"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return np.concatenate(flat).reshape(-1, dim) if flat else np.zeros((0, dim))


def by_dim(batch: pa.RecordBatch, column: str = "vec"):
    """(dim, row numbers, their vectors) for each length in a batch."""
    vectors = batch.column(column)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield dim, rows, matrix(pa.chunked_array([vectors.take(pa.array(rows))]), dim)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.sqrt(np.clip(square, 0, None))


def nearest_bound(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The negated least distance that a region's rows can have: higher is better."""
    return radii - distances(queries, centres)


def product_bound(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The highest inner product that a region's rows can have."""
    return queries @ centres.T + np.sqrt((queries * queries).sum(axis=1))[:, None] * radii


class Regions:
    """Routing objects, radii and rows of each region, by the vectors' length. Lengths that the sample missed are one region, -1."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres
        self.names: dict[int, np.ndarray] = {}
        self.radii: dict[int, np.ndarray] = {}

    def assign(self, dim: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The region of each vector, and its distance to the routing object."""
        if dim not in self.centres:
            return np.full(len(vectors), -1), np.full(len(vectors), np.inf)
        far = distances(vectors, self.centres[dim])
        nearest = far.argmin(axis=1)
        return nearest, np.sqrt(((vectors - self.centres[dim][nearest]) ** 2).sum(axis=1))

    def measure(self, sizes: list[tuple[int, int, float]]):
        """Take (dim, region, radius) of the regions that have rows."""
        for dim in {s[0] for s in sizes}:
            own = sorted((region, radius) for d, region, radius in sizes if d == dim)
            self.names[dim] = np.array([region for region, _ in own])
            self.radii[dim] = np.array([radius for _, radius in own])

    def bounds(self, dim: int, queries: np.ndarray, bound: Callable) -> np.ndarray:
        if dim not in self.centres:
            return np.full((len(queries), len(self.names[dim])), np.inf)
        return bound(queries, self.centres[dim][self.names[dim]], self.radii[dim])


def search(
    vectors: DataFrame,
    queries: Column,
    build: Callable[[np.ndarray, np.ndarray], list[dict]],
    index_fields: str,
    find: Callable,
    bound: Callable,
    best_last: bool,
    score_type: str,
    top: int = 10,
    rows_per_shard: int = 8192,
    queries_per_block: int = 16384,
    rows_per_region: int = 2048,
    most_regions: int = 512,
    name: str = "index",
    visits: list | None = None,
) -> DataFrame:
    """``build(ids, vectors)`` gives the rows of a shard's index, ``find(index, ids, vectors, top)`` yields (query's position,
    ids, scores) of its best rows, ``bound(queries, centres, radii)`` the best score a region can hold, negated if low scores are
    best. ``best_last`` tells that high scores are best. ``visits`` gets the table of (query, region) that met."""
    spark = vectors.sparkSession
    order = Window.partitionBy("vec").orderBy("id")
    rows = vectors.dropDuplicates(["id", "vec"]).withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= top + 1).drop("copy")
    rows = settle(rows, f"{name}-rows")
    asked = vectors.filter(queries).dropDuplicates(["id", "vec"]).select("id", "vec", F.xxhash64("vec").alias("mark"))
    asked = settle(asked, f"{name}-queries")

    wanted = max(1, min(most_regions, rows.count() // rows_per_region))
    drawn = rows.orderBy(F.xxhash64("vec"), "id").select("dim", "vec").limit(wanted).collect()
    regions = Regions({dim: np.unique(np.array([r["vec"] for r in drawn if r["dim"] == dim]), axis=0) for dim in {r["dim"] for r in drawn}})

    def assign(batches):
        for batch in batches:
            region, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for dim, at, own in by_dim(batch):
                region[at], far[at] = regions.assign(dim, own)
            columns = [*(batch.column(c) for c in ("id", "vec", "dim")), pa.array(region), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vec", "dim", "region", "far"])

    placed = settle(rows.mapInArrow(assign, "id long, vec array<double>, dim int, region int, far double"), f"{name}-placed")
    sizes = placed.groupBy("dim", "region").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius")).collect()
    # a little wider, as sums of squares round
    regions.measure([(r["dim"], r["region"], r["radius"] * (1 + 1e-9) + 1e-9) for r in sizes])
    shards = {(r["dim"], r["region"]): -(-r["rows"] // rows_per_shard) for r in sizes}
    cuts = F.broadcast(spark.createDataFrame([(*k, n) for k, n in shards.items()], "dim int, region int, shards int"))

    def index(key, group):
        dim, region, shard = (k.as_py() for k in key)
        ids = group.column("id").to_numpy()
        by = np.argsort(ids, kind="stable")
        pages = build(ids[by], matrix(group.column("vec"), dim)[by])
        return pa.Table.from_pylist([{"dim": dim, "region": region, "shard": shard, **p} for p in pages], schema=arrow_index)

    index_schema = spark.createDataFrame([], f"dim int, region int, shard long, {index_fields}").schema
    arrow_index = to_arrow_schema(index_schema)
    stored = placed.join(cuts, ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards").cast("long")))
    stored = settle(stored.groupBy("dim", "region", "shard").applyInArrow(index, index_schema), name)
    release(placed)

    route_schema = "id long, vec array<double>, mark long, dim int, region int"

    def route(batches):
        """The most promising region of each query; where ``limit`` tells what it has found there, all others that may have as good a score."""
        for batch in batches:
            limits = batch.column("limit").to_numpy(zero_copy_only=False).astype(float) if "limit" in batch.schema.names else None
            taken, dims, found = [], [], []
            for dim, at, own in by_dim(batch):
                if dim not in regions.names:
                    continue
                bounds = regions.bounds(dim, own, bound)
                best = bounds.argmax(axis=1)
                if limits is None:
                    q, r = np.arange(len(at)), best
                else:
                    least = np.where(np.isnan(limits[at]), -np.inf, limits[at] if best_last else -limits[at])
                    # bounds round, too
                    may = bounds >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
                    may[np.arange(len(at)), best] = False
                    q, r = np.nonzero(may)
                taken.append(at[q])
                dims.append(np.full(len(q), dim, dtype=np.int32))
                found.append(regions.names[dim][r].astype(np.int32))
            if taken:
                rows_ = pa.array(np.concatenate(taken))
                columns = [*(batch.column(c).take(rows_) for c in ("id", "vec", "mark")), pa.array(np.concatenate(dims)), pa.array(np.concatenate(found))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "vec", "mark", "dim", "region"])

    out = pa.schema([("query_id", pa.int64()), ("at", pa.int64()), ("vec_id", pa.int64()), ("score", {"long": pa.int64(), "double": pa.float64()}[score_type])])

    def meet(key, pages, asked_):
        columns = [[], [], [], []]
        if pages.num_rows and asked_.num_rows:
            ids, vecs = asked_.column("id").to_numpy(), matrix(asked_.column("vec"), key[0].as_py())
            marks = asked_.column("mark").to_numpy()
            for i, found, scores in find(pages, ids, vecs, top):
                columns[0].append(np.full(len(found), ids[i]))
                columns[1].append(np.full(len(found), marks[i]))
                columns[2].append(found)
                columns[3].append(scores)
        arrays = [np.concatenate(c) if c else np.zeros(0) for c in columns]
        return pa.Table.from_arrays([pa.array(a).cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    best = F.desc("score") if best_last else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id", "at").orderBy(best, "vec_id"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))

    def met(asked_: DataFrame, step: str) -> DataFrame:
        routed = settle(asked_.mapInArrow(route, route_schema), f"{name}-{step}")
        if visits is not None:
            visits.append(routed)
        amounts = routed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / queries_per_block).alias("blocks"))
        amounts = F.broadcast(settle(amounts, f"{name}-blocks"))
        left = stored.join(amounts, ["dim", "region"]).withColumn("block", every(F.col("blocks"))).drop("blocks")
        right = routed.join(amounts, ["dim", "region"]).join(cuts, ["dim", "region"])
        right = right.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("shard", every(F.col("shards")))
        keys = ["dim", "region", "shard", "block"]
        near = left.groupBy(*keys).cogroup(right.select(*keys, "id", "vec", "mark").groupBy(*keys)).applyInArrow(
            meet, f"query_id long, at long, vec_id long, score {score_type}"
        )
        return near.withColumn("rank", rank).filter(F.col("rank") <= top)

    first = settle(met(asked, "first"), f"{name}-first")
    if len(shards) == len({dim for dim, _ in shards}):  # one region each
        return first.select("query_id", "rank", "vec_id", "score")
    limits = first.filter(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("at").alias("mark"), F.col("score").cast("double").alias("limit"))
    second = met(asked.join(limits, ["id", "mark"], "left").select("id", "vec", "mark", "limit"), "others")
    both = first.drop("rank").union(second.drop("rank"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
