"""Forecast models refitted for each period on all that came before it.

History is read once. Tasks sum products of inputs and targets, a packed triangle for each model, step and period; sums over the
periods before one are prefix sums; and the systems of all periods of a step are solved as one batch. Nothing is read again for a period, and
what is shuffled doesn't depend on the number of rows but on tasks, steps and periods.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import over

#: The inputs of the heat forecast in the order of its coefficients.
INPUTS = (
    *("temp", "rh", "press", "wind", "gust", "vis", "ir", "wet_bulb", "wbgt"),
    *("temp_1h", "rh_1h", "wbgt_1h", "temp_d1h", "rh_d1h", "press_d1h", "ir_d1h"),
    *("temp_mean", "temp_std", "wbgt_mean", "wbgt_std", "rh_mean"),
    *("hour_sin", "hour_cos", "doy_sin", "doy_cos"),
)
#: Inputs that models with seasonal terms have besides: what is usual now and at the target, and how far now departs from it.
SEASONAL = ("usual_now", "usual_target", "departure")
MODELS = "kind string, step int, period long, n long, mean array<double>, std array<double>, intercept double, coef array<double>, raw_intercept double, raw_coef array<double>"
_SUMS = "kind string, step int, period long, sums array<double>"


def feature_columns(keys: list[str], time: str = "slot") -> dict[str, Column]:
    """``INPUTS`` of a series with temp, rh, press, wind, gust, vis, ir, wet_bulb and wbgt:
    present values, values and changes of an hour, rolling means and deviations, and the clock and the season as circles."""
    w = over(keys, time)
    hour = w.rowsBetween(-3, 0)
    lag = lambda c: F.lag(c, 4).over(w)
    change = lambda c: F.col(c) - lag(c)
    spread = lambda c: F.coalesce(F.stddev_samp(c).over(hour), F.lit(0.0))
    turn = 2 * 3.141592653589793
    day = (F.col(time) + 10800) % 86400 / 86400 * turn
    year = F.dayofyear(F.timestamp_seconds(time)) / 365.25 * turn
    of = {"hour_sin": F.sin(day), "hour_cos": F.cos(day), "doy_sin": F.sin(year), "doy_cos": F.cos(year)}
    for c in INPUTS:
        channel, _, kind = c.rpartition("_")
        if c not in of:
            of[c] = {"1h": lag, "d1h": change, "mean": lambda x: F.avg(x).over(hour), "std": spread}[kind](channel) if kind in ("1h", "d1h", "mean", "std") else F.col(c)
    return {c: of[c] for c in INPUTS}


def origins(series: DataFrame, keys: list[str], inputs: dict[str, Column], value: str, usual: str, measured: Column, steps: int, period: Column, time: str = "slot") -> DataFrame:
    """Slots that a forecast may start from, measured like the four before them: (keys, time, period, x, v0, u0, ahead), where ``ahead`` has a struct (step, period,
    y, u) for each later slot that was measured. ``period`` is an expression of ``time``."""
    w = over(keys, time)
    rows = series.withColumns({"_ok": measured.cast("int"), "_period": period})
    later = F.collect_list(F.struct("_ok", F.col("_period").alias("period"), F.col(value).alias("y"), F.col(usual).alias("u"))).over(w.rowsBetween(1, steps))
    behind = w.rowsBetween(-4, 0)
    rows = rows.withColumns({"_usable": (F.min("_ok").over(behind) == 1) & (F.count("_ok").over(behind) == 5), "_later": later, **{f"_x{i}": c for i, c in enumerate(inputs.values())}})
    numbered = F.transform("_later", lambda a, i: F.struct((i + 1).cast("int").alias("step"), a["period"].alias("period"), a["y"].alias("y"), a["u"].alias("u"), a["_ok"].alias("ok")))
    ahead = F.transform(F.filter(numbered, lambda a: a["ok"] == 1), lambda a: a.dropFields("ok"))
    x = F.array(*(F.col(f"_x{i}").cast("double") for i in range(len(inputs))))
    return rows.filter("_usable").select(*keys, time, F.col("_period").alias("period"), x.alias("x"), F.col(value).alias("v0"), F.col(usual).alias("u0"), ahead.alias("ahead"))


def _packed(z: np.ndarray) -> np.ndarray:
    return (z.T @ z)[np.triu_indices(z.shape[1])]


def _square(sums: np.ndarray, width: int) -> np.ndarray:
    """Symmetric matrices from packed triangles, one a row."""
    out = np.zeros((len(sums), width, width))
    i, j = np.triu_indices(width)
    out[:, i, j] = sums
    out[:, j, i] = sums
    return out


def period_sums(rows: DataFrame, centre: list[float], most_rows: int = 1000) -> DataFrame:
    """(kind, step, period, sums) of what ``origins`` gave: packed products of (1, inputs, target) by the period of the target for ``ridge``, with the seasonal inputs for
    ``ridge_seasonal``, and of (1, inputs) by the period of the origin, step 0, for ``scale``. ``centre`` is taken off the inputs, so that large
    offsets don't cost digits."""
    shift = np.array(centre)

    def tasks(batches):
        total: dict[tuple, np.ndarray] = {}

        def add(kind, step, period, z):
            key = (kind, int(step), int(period))
            sums = _packed(z)
            total[key] = total[key] + sums if key in total else sums

        def emit():
            keys = list(total)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([total[k] for k in keys], pa.list_(pa.float64()))], names=["kind", "step", "period", "sums"])
            total.clear()

        number = lambda column: column.to_numpy(zero_copy_only=False).astype(float)
        for whole in batches:
            for at in range(0, whole.num_rows, most_rows):
                batch = whole.slice(at, most_rows)
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(shift)) - shift
                v0, u0, origin = (number(batch.column(c)) for c in ("v0", "u0", "period"))
                one = np.ones((len(x), 1))
                for p in np.unique(origin):
                    add("scale", 0, p, np.hstack([one, x])[origin == p])
                ahead = batch.column("ahead")
                row = np.repeat(np.arange(batch.num_rows), ahead.value_lengths().to_numpy(zero_copy_only=False))
                flat = ahead.flatten()
                step, period, y, u1 = (number(flat.field(i)) for i in range(4))
                z = np.hstack([one[row], x[row], u0[row, None], u1[:, None], (v0 - u0)[row, None], y[:, None]])
                plain = [*range(x.shape[1] + 1), z.shape[1] - 1]
                known = ~np.isnan(z).any(axis=1)
                by = np.lexsort((period, step))
                cuts = np.flatnonzero((np.diff(step[by]) != 0) | (np.diff(period[by]) != 0)) + 1
                for part in np.split(by, cuts) if len(by) else ():
                    add("ridge", step[part[0]], period[part[0]], z[part][:, plain])
                    if known[part].any():
                        add("ridge_seasonal", step[part[0]], period[part[0]], z[part[known[part]]])
            if len(total) > 20_000:
                yield from emit()
        yield from emit()

    def add_up(key, group):
        return pd.DataFrame([(*key, np.sum(np.stack(group["sums"].to_numpy()), axis=0))], columns=["kind", "step", "period", "sums"])

    parts = rows.select("x", F.col("v0").cast("double"), F.col("u0").cast("double"), "period", "ahead").mapInArrow(tasks, _SUMS)
    return parts.groupBy("kind", "step", "period").applyInPandas(add_up, _SUMS)  # a row a task in a group


def _before(periods: np.ndarray, sums: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums over the periods before each of ``of``."""
    order = np.argsort(periods)
    upto = np.vstack([np.zeros((1, sums.shape[1])), np.cumsum(sums[order], axis=0)])
    return upto[np.searchsorted(periods[order], of, side="left")]


def solve_ridges(gram: np.ndarray, mean: np.ndarray, std: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts, coefficients on standardised inputs), one a system of ``gram``, products of (1, inputs, target). The intercept is the targets' mean and isn't penalised."""
    n, sx, sy = gram[:, 0, 0], gram[:, 0, 1:-1], gram[:, 0, -1]
    xx, xy = gram[:, 1:-1, 1:-1], gram[:, 1:-1, -1]
    level = sy / n
    cross = mean[:, :, None] * sx[:, None, :]
    spread = xx - cross - cross.transpose(0, 2, 1) + n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    a = spread / (std[:, :, None] * std[:, None, :]) + penalty * np.eye(mean.shape[1])
    b = (xy - level[:, None] * sx) / std
    lower = np.linalg.cholesky(a)
    return level, np.linalg.solve(lower.transpose(0, 2, 1), np.linalg.solve(lower, b[:, :, None]))[:, :, 0]


def _moments(gram: np.ndarray, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (0 counts as 1) of inputs, from products of (1, inputs)."""
    n = gram[:, 0, 0][:, None]
    mean = gram[:, 0, columns] / n
    square = np.diagonal(gram, axis1=1, axis2=2)[:, columns] / n
    variance = square - mean**2
    flat = variance <= 1e-12 * np.maximum(square, 1e-300)
    return mean, np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance)))


def models(sums: DataFrame, centre: list[float], steps: int, penalty: float = 1.0) -> DataFrame:
    """A model for each kind, step and period, from the periods before it, and one for the period after the last. Scales are those of all usable slots of
    the periods before, and of the seasonal inputs those of the rows fitted. ``coef`` are on standardised inputs, ``raw_coef`` on inputs as they are; ``seasonal`` has
    the share of a departure that is left as its only coefficient."""
    shift, k = np.array(centre), len(centre)
    scale = F.col("kind") == "scale"
    each = F.explode(F.when(scale, F.sequence(F.lit(1), F.lit(steps))).otherwise(F.array("step")))
    names = [f.strip().split(" ")[0] for f in MODELS.split(", ")]

    def solve(key, group):
        of = {kind: (g["period"].to_numpy(), np.stack(g["sums"].to_numpy())) for kind, g in group.groupby("kind")}
        if "scale" not in of:
            return pd.DataFrame([], columns=names)
        periods = np.unique(of["scale"][0])
        periods = np.append(periods, periods[-1] + 1)
        found = []
        for kind, width in (("ridge", k + 2), ("ridge_seasonal", k + 5)):
            if kind not in of:
                continue
            gram, all_slots = (_square(_before(*of[name], periods), w) for name, w in ((kind, width), ("scale", k + 1)))
            able = (gram[:, 0, 0] > 0) & (all_slots[:, 0, 0] > 0)
            gram, all_slots, which = gram[able], all_slots[able], periods[able]
            if not len(which):
                continue
            mean, std = _moments(all_slots, slice(1, k + 1))
            if kind == "ridge_seasonal":
                more = _moments(gram, slice(k + 1, k + 4))
                mean, std = np.hstack([mean, more[0]]), np.hstack([std, more[1]])
                now, later, target = k + 3, k + 2, k + 4
                left = (gram[:, now, target] - gram[:, now, later]) / np.where(gram[:, now, now] > 0, gram[:, now, now], np.nan)
                found += [("seasonal", key[0], p, n, [], [], 0.0, [a], 0.0, [a]) for p, n, a in zip(which, gram[:, 0, 0], left, strict=True) if a == a]
            level, coef = solve_ridges(gram, mean, std, penalty)
            raw = coef / std
            offset = np.zeros(mean.shape[1])
            offset[:k] = shift
            base = level - (raw * (mean + offset)).sum(axis=1)
            found += list(zip([kind] * len(which), [key[0]] * len(which), which, gram[:, 0, 0], mean + offset, std, level, coef, base, raw, strict=True))
        return pd.DataFrame(found, columns=names).astype({"step": "int32", "period": "int64", "n": "int64"}) if found else pd.DataFrame([], columns=names)

    # a group has three rows a period
    return sums.withColumn("step", each).groupBy("step").applyInPandas(solve, MODELS)


def predicted(rows: DataFrame, fitted: DataFrame, keep: list[str], period: str = "period") -> DataFrame:
    """(keep, step, kind, n_train, value, y) for each origin and target by the models of the origin's period; ``no_change``, which has no model, among them. A kind whose inputs
    aren't known has no row."""
    one = lambda kind: F.max_by(F.struct("n", "raw_intercept", "raw_coef"), F.when(F.col("kind") == kind, 1)).alias(kind)
    wide = fitted.groupBy("step", F.col("period").alias("_p")).agg(one("seasonal"), one("ridge"), one("ridge_seasonal"))
    each = rows.select(*keep, F.col(period).alias("_of"), "x", "v0", "u0", F.inline("ahead").alias("step", "_target", "y", "u"))
    joined = each.join(wide.withColumnRenamed("_p", "_of"), ["step", "_of"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    u0, u1, v0 = F.col("u0"), F.col("u"), F.col("v0")
    more = F.array(u0, u1, v0 - u0)
    values = {
        "no_change": (F.lit(0).cast("long"), v0),
        "seasonal": (F.col("seasonal.n"), u1 + F.col("seasonal.raw_coef")[0] * (v0 - u0)),
        "ridge": (F.col("ridge.n"), F.col("ridge.raw_intercept") + dot(F.col("x"), F.col("ridge.raw_coef"))),
        "ridge_seasonal": (F.col("ridge_seasonal.n"), F.col("ridge_seasonal.raw_intercept") + dot(F.concat("x", more), F.col("ridge_seasonal.raw_coef"))),
    }
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), n.alias("n_train"), v.alias("value")) for k, (n, v) in values.items()))
    return joined.select(*keep, "step", "y", F.inline(kinds)).filter("value is not null and y is not null")
