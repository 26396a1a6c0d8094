"""Fitted models. Data stay in Spark: what reaches the driver are sums whose number depends on the inputs' count alone."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaling(rows: DataFrame, inputs: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each input; a deviation of 0 counts as 1."""
    sums = rows.agg(*(f(c).alias(f"{n}_{c}") for c in inputs for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (sums[f"m_{c}"], sums[f"s_{c}"] or 1.0) for c in inputs}


def scaled(rows: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


def ridge(rows: DataFrame, inputs: list[str], target: str, penalty: float = 1.0) -> tuple[float, list[float]]:
    """(intercept, coefficients): the target is centred, the inputs are taken as they are, and the intercept isn't penalised. One
    pass sums up the products; the driver solves a system of as many rows as there are inputs."""
    mean = rows.agg(F.avg(target)).first()[0]
    pairs = [(a, b) for i, a in enumerate(inputs) for b in inputs[i:]]
    products = [F.sum(F.col(a) * F.col(b)) for a, b in pairs] + [F.sum(F.col(a) * (F.col(target) - mean)) for a in inputs]
    sums = list(rows.agg(*(p.alias(f"p{i}") for i, p in enumerate(products))).first())
    gram = penalty * np.eye(len(inputs))
    for (a, b), s in zip(pairs, sums, strict=False):
        i, j = inputs.index(a), inputs.index(b)
        gram[i, j] += s
        if i != j:
            gram[j, i] += s
    return mean, np.linalg.solve(gram, np.array(sums[len(pairs) :])).tolist()


def logistic(rows: DataFrame, inputs: list[str], target: str, penalty: float = 1.0) -> tuple[float, list[float]]:
    """(intercept, coefficients) that minimise log loss plus half the penalty on the coefficients' squares. ``rows`` are scaled."""
    n = rows.count()
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select("features", F.col(target).cast("double").alias("label"))
    model = LogisticRegression(regParam=penalty / n, elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=100).fit(assembled)
    return model.intercept, model.coefficients.toArray().tolist()


def clusters(rows: DataFrame, inputs: list[str], k: int = 4, seeds: tuple[int, ...] = (11, 23, 37), rounds: int = 100) -> list[list[float]]:
    """Centres of the best of several k-means runs by inertia, sorted by their first input, so that names don't depend on a run. Equal rows are one point of their
    number's weight, so a step's work grows with what is distinct; points are sorted, so that a seed picks the same ones again."""
    points = rows.groupBy(*inputs).agg(F.count(F.lit(1)).cast("double").alias("_weight")).sortWithinPartitions(*inputs)
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(points).select("features", "_weight").persist()
    try:
        runs = [KMeans(k=k, seed=s, maxIter=rounds, weightCol="_weight").fit(assembled) for s in seeds]
        best = min(runs, key=lambda m: m.summary.trainingCost)
        return sorted(c.tolist() for c in best.clusterCenters())
    finally:
        assembled.unpersist()
