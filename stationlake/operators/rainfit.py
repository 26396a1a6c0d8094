"""Chances of rain by logistic regression, refitted for each period on all that came before it.

All candidates and periods are fitted together: an iteration is one aggregation over the rows, in which tasks sum gradients and Hessians of every
candidate and period at once. What reaches the driver in an iteration is one packed system a candidate and period, and what
goes back is one vector of weights; rows stay where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import over

#: The inputs in their order, and the sets of them that are tried, simplest first.
INPUTS = (
    *("rh", "rh_d1h", "press_d1h", "press_d3h", "temp_d1h", "temp_d3h"),
    *("hour_sin", "hour_cos", "doy_sin", "doy_cos", "rain_1h", "rain_3h"),
)
CANDIDATES = {"weather": [i for i, c in enumerate(INPUTS) if not c.startswith("doy")], "weather_and_season": list(range(len(INPUTS)))}
#: A Brier score within this of the best counts as equal, and the simpler set is taken.
TIE = 0.0001
_SYSTEM = "candidate string, period long, n double, sums array<double>"


def samples(series: DataFrame, keys: list[str], usable: Column, known: Column, least_known: int, wet: float, period, ahead: int = 12, time: str = "slot") -> DataFrame:
    """(keys, time, period, ends, x, rain, y) of origins whose inputs were measured: ``x`` in the order of ``INPUTS``, ``y`` whether at least ``wet`` falls in the ``ahead`` slots after,
    of which with those before ``least_known`` have to be known; ``ends`` is the period in which those slots end. ``period`` maps an expression of time to its period; ``series`` has rh, press, temp and rain, 0 where none
    is known."""
    w = over(keys, time)
    back = lambda c, n: F.col(c) - F.lag(c, n).over(w)
    rained = lambda n: F.log1p(F.sum("rain").over(w.rowsBetween(-n + 1, 0)))
    turn = 2 * 3.141592653589793
    day = (F.col(time) + 10800) % 86400 / 86400 * turn
    year = F.dayofyear(F.timestamp_seconds(time)) / 365.25 * turn
    of = {"rh": F.col("rh"), "rh_d1h": back("rh", 4), "press_d1h": back("press", 4), "press_d3h": back("press", 12), "temp_d1h": back("temp", 4), "temp_d3h": back("temp", 12)}
    of |= {"hour_sin": F.sin(day), "hour_cos": F.cos(day), "doy_sin": F.sin(year), "doy_cos": F.cos(year), "rain_1h": rained(4), "rain_3h": rained(12)}
    rows = series.withColumns(
        {
            **{f"_x{i}": of[c] for i, c in enumerate(INPUTS)},
            "_usable": usable,
            "_known": F.count(F.when(known, 1)).over(w.rowsBetween(-ahead + 1, ahead)),
            "_ahead": F.sum("rain").over(w.rowsBetween(1, ahead)),
            "_left": F.count(F.lit(1)).over(w.rowsBetween(1, ahead)),
            "_past": F.count(F.lit(1)).over(w.rowsBetween(-ahead, -1)),
        }
    )
    rows = rows.filter(F.col("_usable") & (F.col("_known") >= least_known) & (F.col("_left") == ahead) & (F.col("_past") == ahead))
    x = F.array(*(F.col(f"_x{i}").cast("double") for i in range(len(INPUTS))))
    return rows.select(*keys, time, period(F.col(time)).alias("period"), period(F.col(time) + ahead * 900).alias("ends"), x.alias("x"), "rain", (F.col("_ahead") >= wet).cast("int").alias("y"))


def old_rule() -> Column:
    """The chance by the rule that models have to beat: rain now, else by the fall of pressure and by humidity. Fixed values."""
    fall, rh = F.col("x")[INPUTS.index("press_d1h")], F.col("x")[INPUTS.index("rh")]
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    score = 0.05 + add(fall < -0.5, 0.2) + add(fall < -1.2, 0.15) + add(rh > 80, 0.15) + add(rh > 90, 0.1)
    return F.when(F.col("rain") > 0, 0.85).otherwise(F.least(F.lit(0.92), score))


def _triangle(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(width)


def _system(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Packed Hessian and gradient of the log-likelihood."""
    p = 1 / (1 + np.exp(-(z @ weights)))
    hessian = (z * (p * (1 - p))[:, None]).T @ z
    return np.concatenate([hessian[_triangle(z.shape[1])], z.T @ (y - p)])


def _summed(rows: DataFrame, tasks) -> pd.DataFrame:
    """The packed systems of all candidates and periods, summed over the tasks."""

    def add_up(key, group):
        return pd.DataFrame([(*key, group["n"].sum(), np.sum(np.stack(group["sums"].to_numpy()), axis=0))], columns=["candidate", "period", "n", "sums"])

    return rows.mapInArrow(tasks, _SYSTEM).groupBy("candidate", "period").applyInPandas(add_up, _SYSTEM).toPandas()


def _over_rows(systems):
    """A task's work: ``systems(x, y, ends)`` yields (candidate, period, n, sums) for a batch; sums are added up over batches."""

    def run(batches):
        total: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, ends = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "ends"))
            for candidate, period, n, sums in systems(x, y, ends):
                have = total.setdefault((candidate, int(period)), [0.0, np.zeros(len(sums))])
                have[0] += n
                have[1] += sums
        keys = list(total)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([total[k][0] for k in keys], pa.float64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([total[k][1] for k in keys], pa.list_(pa.float64()))], names=["candidate", "period", "n", "sums"])

    return run


def fit_by_period(rows: DataFrame, candidates: dict[str, list[int]] = CANDIDATES, penalty: float = 1.0, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(candidate, period, n, rate, mean, std, intercept, coef) for each period of ``rows`` and the one after the last, from rows that end before it. Inputs are standardised over
    those rows; slopes are penalised, the intercept isn't. Periods before which it was always or never wet have no model."""
    data = rows.select("x", F.col("y").cast("double"), "ends").persist()
    try:
        periods = sorted(r[0] for r in rows.select("period").distinct().collect())  # one a period
        periods = np.array([*periods, periods[-1] + 1] if periods else [], dtype=float)

        def moments(x, y, ends):
            for p in np.unique(ends):
                at = x[ends == p]
                yield "", p, len(at), np.concatenate([at.sum(axis=0), (at * at).sum(axis=0), [y[ends == p].sum()]])

        found = _summed(data, _over_rows(moments))
        fits: dict[tuple[str, int], dict] = {}
        for p in periods:
            before = found[found["period"] < p]
            n = before["n"].sum()
            if not n:
                continue
            sums = np.sum(np.stack(before["sums"].to_numpy()), axis=0)
            k = (len(sums) - 1) // 2
            mean, wet = sums[:k] / n, sums[-1]
            variance = sums[k : 2 * k] / n - mean**2
            std = np.sqrt(np.where(variance > 1e-12 * np.maximum(sums[k : 2 * k] / n, 1e-300), variance, 1.0))
            if 0 < wet < n:
                for name, cols in candidates.items():
                    fits[name, int(p)] = {"n": n, "rate": wet / n, "cols": cols, "mean": mean[cols], "std": std[cols], "w": np.zeros(len(cols) + 1)}
        active = dict(fits)
        for _ in range(rounds):
            if not active:
                break
            now = {key: (f["cols"], f["mean"], f["std"], f["w"]) for key, f in active.items()}

            def systems(x, y, ends, now=now):
                for (name, p), (cols, mean, std, w) in now.items():
                    train = ends < p
                    if train.any():
                        z = np.hstack([np.ones((train.sum(), 1)), (x[train][:, cols] - mean) / std])
                        yield name, p, len(z), _system(z, y[train], w)

            for name, p, _, sums in _summed(data, _over_rows(systems)).itertuples(index=False):
                f = active[name, p]
                width = len(f["w"])
                hessian, gradient = np.zeros((width, width)), np.array(sums[-width:])
                i, j = _triangle(width)
                hessian[i, j] = hessian[j, i] = sums[:-width]
                slopes = np.r_[0.0, np.full(width - 1, penalty)]
                step = np.linalg.solve(hessian + np.diag(slopes), gradient - slopes * f["w"])
                f["w"] = f["w"] + step
                if np.abs(step).max() < tolerance:
                    del active[name, p]
        table = [(name, p, int(f["n"]), float(f["rate"]), f["mean"].tolist(), f["std"].tolist(), float(f["w"][0]), f["w"][1:].tolist()) for (name, p), f in fits.items()]
    finally:
        data.unpersist()
    return rows.sparkSession.createDataFrame(table, "candidate string, period long, n long, rate double, mean array<double>, std array<double>, intercept double, coef array<double>")


def chances(rows: DataFrame, fitted: DataFrame, keep: list[str], candidates: dict[str, list[int]] = CANDIDATES) -> DataFrame:
    """(keep, candidate, rate, p) of each row by the models of its period."""
    cols = F.coalesce(*(F.when(F.col("candidate") == name, F.array(*map(F.lit, at))) for name, at in candidates.items()))
    scaled = F.transform(cols, lambda c, i: (F.get("x", c) - F.get("mean", i)) / F.get("std", i) * F.get("coef", i))
    z = F.aggregate(scaled, F.col("intercept"), lambda a, b: a + b)
    return rows.join(fitted, "period").select(*keep, "candidate", "rate", (1 / (1 + F.exp(-z))).alias("p"))


def choose(scores: DataFrame, order: list[str]) -> DataFrame:
    """Of (candidate, brier) the first in ``order`` whose score, to five decimals, is within ``TIE`` of the best: a row (chosen, chosen_brier)."""
    rounded = F.floor(F.col("brier") * 100000 + 0.5) / 100000
    best = scores.agg(F.min(rounded).alias("best"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("candidate"))
    near = scores.crossJoin(F.broadcast(best)).filter(rounded <= F.col("best") + TIE)  # a row a candidate
    return near.agg(F.min_by("candidate", place).alias("chosen"), F.min_by("brier", place).alias("chosen_brier"))
