from __future__ import annotations

import numpy as np
import pytest

from stationlake.operators import fitting


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.3, 400) + 4
    wet = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.7)))).astype(int)
    rows = spark.createDataFrame([(*map(float, a), float(b), int(c)) for a, b, c in zip(x, y, wet)], "a double, b double, c double, y double, wet int")
    return x, y, wet, rows


def test_ridge_solves_the_normal_equations(data):
    x, y, _, rows = data
    intercept, found = fitting.ridge(rows, ["a", "b", "c"], "y", 3.0)
    want = np.linalg.solve(x.T @ x + 3 * np.eye(3), x.T @ (y - y.mean()))
    assert intercept == pytest.approx(y.mean()) and found == pytest.approx(want.tolist(), rel=1e-9)


def test_logistic_matches_newton(data):
    x, _, wet, rows = data
    design, b = np.hstack([np.ones((400, 1)), x]), np.zeros(4)
    penalty = np.diag([0, 1.0, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ b))
        b += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (wet - p) - penalty @ b)
    intercept, found = fitting.logistic(rows, ["a", "b", "c"], "wet")
    assert [intercept, *found] == pytest.approx(b.tolist(), abs=1e-4)


def test_clusters_find_their_centres(spark):
    rng = np.random.default_rng(3)
    centres = [(0.0, 0.0), (10.0, 0.0), (20.0, 5.0), (30.0, -5.0)]
    rows = [tuple(map(float, rng.normal(c, 0.3))) for c in centres for _ in range(60)]
    found = fitting.clusters(spark.createDataFrame(rows, "x double, y double"), ["x", "y"])
    assert np.abs(np.array(found) - np.array(centres)).max() < 0.3


def test_scaling_of_a_constant(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    assert fitting.scaling(rows, ["a", "b"]) == {"a": (1.0, 1.0), "b": (3.0, 1.0)}
