"""Exact search for the highest inner products by best-first search in M-trees.

The inner product isn't a metric, so a component sqrt(M^2 - |x|^2) is added to each row, where M is the longest row's
length, and 0 to each query: then the squared distance is |q|^2 + M^2 - 2 q.x, and the highest products are the nearest
rows. Each shard's tree consists of pages. An entry of an inner page has a routing object, the radius that covers all
rows below it, its distance to the page's own routing object, and a child; an entry of a leaf has a row and that
distance. A search takes the page with the least possible distance first. An entry needs no distance of its own
where | d(query, page) - d(entry, page) | - radius exceeds the distance of the worst row kept so far.

Integer vectors give exact integer scores. Ties go to the smaller id. See ``vector_search`` for nulls, copies and shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_search import finite, product_bound, search

PAGE = 512
FANOUT = 12
FIELDS = (
    "page int, leaf boolean, ids array<long>, objects binary, radii array<double>, to_parent array<double>, children array<int>"
)


def lift(x: np.ndarray, longest2: float) -> np.ndarray:
    rest = np.clip(longest2 - (x * x).sum(axis=1), 0, None)
    return np.hstack([x, np.sqrt(rest)[:, None]])


def _spread(points: np.ndarray, at: np.ndarray, rng) -> list[np.ndarray]:
    """Parts of the rows ``at``, each near one of some routing objects."""
    seeds = rng.choice(at, size=min(FANOUT, -(-2 * len(at) // PAGE)), replace=False)
    nearest = ((points[at] ** 2).sum(axis=1)[:, None] - 2 * points[at] @ points[seeds].T + (points[seeds] ** 2).sum(axis=1)).argmin(axis=1)
    parts = [p for k in range(len(seeds)) if len(p := at[nearest == k])]
    if len(parts) == 1:  # equal rows
        parts = np.array_split(at, min(FANOUT, -(-len(at) // PAGE)))
    return parts


def build(ids: np.ndarray, rows: np.ndarray) -> list[dict]:
    """The pages of one tree; page 0 is the root. ``objects`` are rows without the added component in doubles, with the
    squared length M^2 of the shard in front, so that a page can be read alone."""
    rng = np.random.default_rng(len(ids))
    longest2 = float((rows * rows).sum(axis=1).max())
    points = lift(rows, longest2)
    pages: list[dict] = []
    gap = lambda a, b: np.sqrt(((points[a] - points[b]) ** 2).sum(axis=-1))

    def page(at: np.ndarray, own: int) -> int:
        here = len(pages)
        pages.append({"page": here})
        head = np.array([longest2])
        if len(at) <= PAGE:
            pages[here] |= {"leaf": True, "ids": ids[at].tolist(), "objects": np.concatenate([head, rows[at].ravel()]).tobytes()}
            pages[here] |= {"radii": [], "to_parent": gap(at, own).tolist(), "children": []}
            return here
        objects, radii, children = [], [], []
        for part in _spread(points, at, rng):
            centre = points[part].mean(axis=0)
            route = part[((points[part] - centre) ** 2).sum(axis=1).argmin()]
            objects.append(route)
            radii.append(float(gap(part, route).max()))
            children.append(page(part, route))
        objects = np.array(objects)
        pages[here] |= {"leaf": False, "ids": [], "objects": np.concatenate([head, rows[objects].ravel()]).tobytes()}
        pages[here] |= {"radii": radii, "to_parent": gap(objects, own).tolist(), "children": children}
        return here

    page(np.arange(len(ids)), 0)
    pages[0]["to_parent"] = []  # the root has no routing object
    return pages


class Tree:
    def __init__(self, table: pa.Table, dim: int):
        self.pages: dict[int, tuple] = {}
        for p in table.to_pylist():
            data = np.frombuffer(p["objects"])
            rows = data[1:].reshape(-1, dim)
            self.longest2 = float(data[0])
            names = np.array(p["ids"], dtype=np.int64)
            to_parent = np.array(p["to_parent"]) if p["to_parent"] else None
            self.pages[p["page"]] = (p["leaf"], names, rows, np.array(p["radii"]), to_parent, p["children"])
        #: Distances computed and avoided so far.
        self.computed = self.avoided = 0

    def nearest(self, query_id: int, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        base = float(q @ q) + self.longest2
        slack = 1e-9 * max(base, 1.0) ** 0.5 + 1e-9
        worst = np.inf
        names, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        heap = [(0.0, 0, 0.0)]
        while heap:
            least, number, from_page = heapq.heappop(heap)
            if least > worst + slack:
                break
            leaf, ids, rows, radii, to_parent, children = self.pages[number]
            reach = radii if not leaf else 0.0
            if to_parent is not None and np.isfinite(worst):
                near = np.flatnonzero(np.abs(from_page - to_parent) - reach <= worst + slack)
            else:
                near = np.arange(len(rows))
            self.computed += len(near)
            self.avoided += len(rows) - len(near)
            if not len(near):
                continue
            products = rows @ q if len(near) == len(rows) else rows[near] @ q
            if leaf:
                keep = ids[near] != query_id
                if len(names) >= top:
                    keep &= products >= scores[-1]
                if not keep.any():
                    continue
                own, products = ids[near][keep], products[keep]
                names, scores = np.concatenate([names, own]), np.concatenate([scores, products])
                if len(names) >= top:
                    by = np.lexsort((names, -scores))[:top]
                    names, scores = names[by], scores[by]
                    worst = max(0.0, base - 2 * scores[-1]) ** 0.5
            else:
                far = np.sqrt(np.clip(base - 2 * products, 0, None))
                for d, k in zip(far.tolist(), near.tolist(), strict=True):
                    bound = max(least, d - radii[k])
                    if bound <= worst + slack:
                        heapq.heappush(heap, (bound, children[k], d))
        by = np.lexsort((names, -scores))
        return names[by], scores[by]


def find(pages: pa.Table, ids: np.ndarray, queries: np.ndarray, top: int):
    tree = Tree(pages, queries.shape[1])
    for i, q in enumerate(queries):
        names, scores = tree.nearest(int(ids[i]), q, top)
        yield i, names, scores


def top_products(
    rows: DataFrame, queries: Column, scale: int = 1024, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", **options
) -> DataFrame:
    """For each row where ``queries`` (over ``id``) holds, its ``top`` highest inner products with other rows, on components
    floor(scale * x): query_id, rank, vec_id, score. Products are exact below 2^53. ``options`` are those of ``search``."""
    whole = finite(rows, id_col, vector_col).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    return search(whole, queries, build, FIELDS, find, product_bound, True, "long", top, name="mtree", **options)
