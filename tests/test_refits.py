"""Models refitted by period, against plain fits that read the rows again for each period."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationlake.operators import rainfit, regression
from stationlake.plans import refits


@pytest.fixture(scope="module")
def rows():
    """(period, x, v0, u0, ahead) with targets in the same and the next period, some without what is usual."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(400):
        period = 10 + i // 100
        x = [float(v) for v in rng.normal(size=3) * [1.0, 5.0, 0.1] + [850.0, 0.0, 3.0]]
        usual = lambda: None if rng.random() < 0.1 else float(rng.normal(20))
        ahead = [(s, period + (i % 100 + s) // 100, float(x[0] - 830 + x[1] * s + rng.normal()), usual()) for s in (1, 2) if rng.random() < 0.9]
        out.append((i, period, x, float(20 + rng.normal()), usual(), ahead))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, period long, x array<double>, v0 double, u0 double, ahead array<struct<step:int,period:long,y:double,u:double>>").repartition(5)


def plain_ridge(rows, step, period, seasonal, penalty=1.0):
    usable = np.array([r[2] for r in rows if r[1] < period])
    mean, std = usable.mean(axis=0), usable.std(axis=0)
    z, more, y = [], [], []
    for _, _, x, v0, u0, ahead in rows:
        for s, p, target, u1 in ahead:
            if s == step and p < period and (not seasonal or None not in (u0, u1)):
                z.append((np.array(x) - mean) / std)
                more.append((u0, u1, v0 - u0) if seasonal else ())
                y.append(target)
    z, more, y = np.array(z), np.array(more), np.array(y)
    if seasonal:
        z = np.hstack([z, (more - more.mean(axis=0)) / more.std(axis=0)])
    return len(y), y.mean(), np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y - y.mean()))


def test_ridges_equal_plain_solutions(frame, rows):
    centre = [850.0, 0.0, 3.0]
    found = {(m["kind"], m["step"], m["period"]): m for m in regression.models(regression.period_sums(frame, centre), centre, 2).collect()}
    assert {k for k in found if k[0] == "ridge"} == {("ridge", s, p) for s in (1, 2) for p in (11, 12, 13, 14)}
    for (kind, step, period), m in found.items():
        if kind == "seasonal":
            pairs = [(v0 - u0, y - u1) for _, _, _, v0, u0, ahead in rows for s, p, y, u1 in ahead if s == step and p < period and None not in (u0, u1)]
            assert m["coef"][0] == pytest.approx(sum(a * b for a, b in pairs) / sum(a * a for a, _ in pairs), rel=1e-9)
        else:
            n, level, coef = plain_ridge(rows, step, period, kind == "ridge_seasonal")
            assert m["n"] == n and m["intercept"] == pytest.approx(level) and m["coef"] == pytest.approx(coef.tolist(), rel=1e-7, abs=1e-8)


def test_forecasts_by_models_of_their_period(frame, rows):
    centre = [850.0, 0.0, 3.0]
    fitted = regression.models(regression.period_sums(frame, centre), centre, 2)
    said = {(r["id"], r["step"], r["kind"]): r["value"] for r in regression.predicted(frame, fitted, ["id"]).collect()}
    assert not any(i < 100 for i, _, _ in said)  # nothing is known before the first period
    for i, period, x, _, _, ahead in rows[100:140]:
        for step, _, _, _ in ahead:
            _, level, coef = plain_ridge(rows, step, period, False)
            usable = np.array([r[2] for r in rows if r[1] < period])
            want = level + ((np.array(x) - usable.mean(axis=0)) / usable.std(axis=0)) @ coef
            assert said[i, step, "ridge"] == pytest.approx(want, rel=1e-9)


def test_ridge_edges(spark, frame):
    centre = [0.0, 0.0, 0.0]
    assert regression.models(regression.period_sums(frame.limit(0), centre), centre, 2).count() == 0
    one = frame.filter("period = 10").withColumn("ahead", F.filter("ahead", lambda a: a["period"] == 10))
    assert {m["period"] for m in regression.models(regression.period_sums(one, centre), centre, 2).collect()} == {11}
    flat = one.withColumn("x", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    m = regression.models(regression.period_sums(flat, centre), centre, 2).filter("kind = 'ridge'").first()
    assert m["coef"] == pytest.approx([0, 0, 0]) and m["std"] == [1, 1, 1]


def test_inputs_are_in_order(spark):
    assert len(regression.INPUTS) == 25 and list(regression.feature_columns(["k"])) == list(regression.INPUTS) == refits.INPUTS


@pytest.fixture(scope="module")
def wet(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 12)) * 3 + 40
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] - 41) / 2))).astype(int)
    ends = np.arange(600) // 150
    table = [(int(i), int(e), int(e), [float(v) for v in a], int(w), 0.0) for i, (e, a, w) in enumerate(zip(ends, x, y, strict=True))]
    return x, y, ends, spark.createDataFrame(table, "id int, period long, ends long, x array<double>, y int, rain double").repartition(4)


def newton(x, y, penalty=1.0):
    z = np.hstack([np.ones((len(x), 1)), (x - x.mean(axis=0)) / x.std(axis=0)])
    w, slopes = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], penalty)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ w)))
        w = w + np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(slopes), z.T @ (y - p) - slopes * w)
    return w


def test_all_periods_at_once_equal_newton_on_each(wet):
    x, y, ends, rows = wet
    found = {(m["candidate"], m["period"]): m for m in rainfit.fit_by_period(rows).collect()}
    assert found.keys() == {(c, p) for c in rainfit.CANDIDATES for p in (1, 2, 3, 4)}
    for (candidate, period), m in found.items():
        train = ends < period
        want = newton(x[train][:, rainfit.CANDIDATES[candidate]], y[train])
        assert [m["intercept"], *m["coef"]] == pytest.approx(want.tolist(), rel=1e-8, abs=1e-9)
        assert m["n"] == train.sum() and m["rate"] == pytest.approx(y[train].mean())


def test_chances_by_models_of_the_period(wet):
    x, y, ends, rows = wet
    fitted = rainfit.fit_by_period(rows)
    said = {(r["id"], r["candidate"]): r["p"] for r in rainfit.chances(rows, fitted, ["id"]).collect()}
    cols = rainfit.CANDIDATES["weather"]
    train = ends < 2
    w = newton(x[train][:, cols], y[train])
    z = w[0] + ((x[310][cols] - x[train][:, cols].mean(axis=0)) / x[train][:, cols].std(axis=0)) @ w[1:]
    assert said[310, "weather"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-8)


def test_logistic_edges(wet):
    rows = wet[3]
    assert rainfit.fit_by_period(rows.limit(0)).count() == 0
    dry = rows.withColumn("y", F.lit(0))
    assert rainfit.fit_by_period(dry).count() == 0
    late = rows.withColumn("y", F.when(F.col("period") == 0, 0).otherwise(F.col("y")))
    assert {m["period"] for m in rainfit.fit_by_period(late).collect()} == {2, 3, 4}


@pytest.mark.parametrize(("second", "chosen"), [(0.12304, "weather"), (0.1231, "weather"), (0.1229, "weather_and_season")])
def test_the_simpler_of_near_candidates(spark, second, chosen):
    scores = spark.createDataFrame([("weather", 0.12313), ("weather_and_season", second)], "candidate string, brier double")
    assert rainfit.choose(scores, list(rainfit.CANDIDATES)).first()["chosen"] == chosen


def test_old_rule(spark):
    x = lambda rh, fall: [float(rh), 0.0, float(fall), *[0.0] * 9]
    rows = [(x(50, 0), 0.2), (x(50, 0), 0.0), (x(85, -0.6), 0.0), (x(95, -1.3), 0.0)]
    found = [r[0] for r in spark.createDataFrame(rows, "x array<double>, rain double").select(rainfit.old_rule()).collect()]
    assert found == pytest.approx([0.85, 0.05, 0.4, 0.65])
