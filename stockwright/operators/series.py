"""Series operators on long ``(key, i, value)`` tables: one-step models, walk-forward tests, cycles, residuals.

A key's rows are positions of its time axis, so windows by key hold at most one row per period, however many
order lines fell into it.  All windows of a key share one shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import groups
from . import metrics

MAD_TO_SIGMA = 0.6745
MEAN_ABS_TO_SIGMA = 0.7979
MIN_POINTS = 3


def one_step(series: DataFrame, period: int = 7) -> DataFrame:
    """Each point's one-step predictions from the points before it; 0 where there are none."""
    w = Window.partitionBy("key").orderBy("i")
    zero = F.lit(0.0)
    last = F.lag("value", 1).over(w)
    return series.withColumns({
        "mean": F.coalesce(F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), zero),
        "naive": F.coalesce(last, zero),
        f"ma{period}": F.coalesce(F.avg("value").over(w.rowsBetween(-period, -1)), zero),
        f"snaive{period}": F.coalesce(F.lag("value", period).over(w), last, zero),
    })


def test_part(predicted: DataFrame, test_len: int) -> DataFrame:
    """The last ``min(test_len, max(1, n // 3))`` points of each key; keys under three points are left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    size = F.least(F.lit(test_len), F.greatest(F.lit(1), F.floor(F.col("_n") / 3)))
    place = F.row_number().over(Window.partitionBy("key").orderBy("i"))
    return (
        predicted.withColumns({"_n": n, "_p": place})
        .where((F.col("_n") >= MIN_POINTS) & (F.col("_p") > F.col("_n") - size)).drop("_n", "_p")
    )


def melt_models(predicted: DataFrame, models: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in models])
    return predicted.select("key", "i", F.col("value").alias("actual"), F.explode(pairs).alias("_m")).select(
        "key", "i", "actual", "_m.model", "_m.pred"
    )


def design(values: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rows from position ``period`` on: intercept, trend, cycle dummies, lag 1, lag ``period``."""
    i = np.arange(period, len(values))
    dummies = (i[:, None] % period == np.arange(1, period)[None, :]).astype(float)
    x = np.column_stack([np.ones(len(i)), i, dummies, values[i - 1], values[i - period]])
    return x, values[period:]


class RunningFit:
    """Least squares of several equally long series at once, from normal equations that grow day by day.

    A day's columns: 1, the day, its place in the cycle (place 0 left out), the values a day and a cycle before.
    Days are added once, whatever the number of refits; a refit solves one small system per series.
    """

    DAYS = 256  # added together

    def __init__(self, values: np.ndarray, period: int):
        self.values, self.period, self.upto = values, period, period
        self.square = np.zeros((len(values), period + 3, period + 3))
        self.cross = np.zeros((len(values), period + 3))

    def advance(self, upto: int) -> None:
        p, y = self.period, self.values
        while self.upto < upto:
            i = np.arange(self.upto, min(upto, self.upto + self.DAYS))
            x = np.empty((len(y), len(i), p + 3))
            x[:, :, 0], x[:, :, 1], x[:, :, 2 : p + 1] = 1.0, i, i[:, None] % p == np.arange(1, p)
            x[:, :, p + 1], x[:, :, p + 2] = y[:, i - 1], y[:, i - p]
            flip = x.transpose(0, 2, 1)
            self.square += flip @ x
            self.cross += (flip @ y[:, i, None])[:, :, 0]
            self.upto = int(i[-1]) + 1

    def weights(self) -> np.ndarray:
        """One row per series; directions that its days do not determine get no weight."""
        size = np.sqrt(np.maximum(np.einsum("bii->bi", self.square), 1e-300))
        root, axes = np.linalg.eigh(self.square / size[:, :, None] / size[:, None, :])
        inverse = np.where(root > 1e-10 * root[:, -1:], 1 / np.where(root > 0, root, 1.0), 0.0)
        turned = np.einsum("bji,bj->bi", axes, self.cross / size)
        return np.einsum("bij,bj->bi", axes, turned * inverse) / size


def predict(weights: np.ndarray, i: int, period: int, lag1: float, lagp: float) -> float:
    place = i % period
    cycle = weights[1 + place] if place else 0.0
    return max(0.0, weights[0] + weights[1] * i + cycle + weights[period + 1] * lag1 + weights[period + 2] * lagp)


def predictions(weights: np.ndarray, i: np.ndarray, period: int, values: np.ndarray) -> np.ndarray:
    """``predict`` of the places ``i``, each from the ``values`` before it."""
    place = i % period
    cycle = np.where(place > 0, weights[1 + place], 0.0)
    return np.maximum(0.0, weights[0] + weights[1] * i + cycle + weights[period + 1] * values[i - 1] + weights[period + 2] * values[i - period])


def seasonal_linear_steps(series: DataFrame, period: int = 7, test_len: int = 21) -> DataFrame:
    """One-step seasonal-linear predictions of the test points, refitted at each; last value when too short."""

    def per_key(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        y = pdf["value"].to_numpy(float)
        n = len(y)
        size = min(test_len, max(1, n // 3)) if n >= MIN_POINTS else 0
        fit, out = RunningFit(y[None, :], period), []
        for t in range(n - size, n):
            if t < 2 * period + 2:
                out.append(y[t - 1] if t else 0.0)
                continue
            fit.advance(t)
            out.append(predict(fit.weights()[0], t, period, y[t - 1], y[t - period]))
        return pd.DataFrame({"key": pdf["key"].to_numpy()[n - size :], "i": pdf["i"].to_numpy()[n - size :],
                             "actual": y[n - size :], "model": f"seas_linear{period}", "pred": out})

    return series.select("key", "i", "value").groupBy("key").applyInPandas(
        per_key, "key string, i bigint, actual double, model string, pred double"
    )


def compare_models(series: DataFrame, period: int = 7, test_len: int | None = None, with_linear: bool = True) -> DataFrame:
    """Walk-forward errors of every model per key, ranked by MAE; the default test length is two cycles."""
    test_len = test_len if test_len is not None else 2 * period
    names = ["mean", "naive", f"ma{period}", f"snaive{period}"]
    pairs = melt_models(test_part(one_step(series, period), test_len), names)
    if with_linear:
        pairs = pairs.unionByName(seasonal_linear_steps(series, period, test_len))
    scored = metrics.point_errors(pairs, ["key", "model"])
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.round("mae", 3), "model"))
    return scored.withColumn("rank", rank.cast("bigint"))


# --- cycles and residuals ----------------------------------------------------------------------------


def cycle_profile(series: DataFrame, period: int, how: str = "mean") -> DataFrame:
    """Mean or median per key and position ``i mod period``, counted from the series start."""
    agg = F.avg("value") if how == "mean" else F.percentile("value", F.lit(0.5))
    return series.groupBy("key", F.pmod("i", F.lit(period)).alias("position")).agg(agg.alias("level"))


def scale_of(mad: Column, mean_abs: Column, min_scale: float = 1.0) -> tuple[Column, Column]:
    """Robust scale and the rule that gave it: MAD, else mean absolute deviation where MAD is 0, else the floor."""
    by_mad, by_mean = mad / MAD_TO_SIGMA, mean_abs / MEAN_ABS_TO_SIGMA
    use_mad = (mad > 0) & (by_mad >= min_scale)
    use_mean = (mad == 0) & (by_mean >= min_scale)
    scale = F.when(use_mad, by_mad).when(use_mean, by_mean).otherwise(F.lit(min_scale))
    return scale, F.when(use_mad, "mad").when(use_mean, "mean_abs_dev").otherwise("floor")


def residual_rule(series: DataFrame, period: int, min_scale: float = 1.0, together: bool = False, twins: bool = False,
                  kept: list[str] | None = None, given: tuple[str, ...] = ("expected", "residual", "robust_z", "method")) -> DataFrame:
    """``series`` (key, i, value and any other columns) with ``expected, residual, robust_z, method``, all NULL in keys
    too short for the rule.  A key's points are worked on at once; ``together``: they follow each other already.
    ``twins``: one column more, the robust z of all points at the same place of the key, NULL where there is one.
    ``kept`` and ``given``: the columns of ``series`` and of the rule that are asked for."""

    placed = series.withColumn("_pos", F.pmod("i", F.lit(period)))
    made = {**{n: "string" if n == "method" else "double" for n in given}, **({"twins": "array<double>"} if twins else {})}
    return groups.in_groups(placed, "key", "i", ["value", "_pos", "i"], made, lambda m: rule(m, period, min_scale, made), together,
                            series.columns if kept is None else kept)


def rule(m: groups.Matrices, period: int, min_scale: float, made: dict[str, str]) -> dict:
    """The columns ``made`` of ``residual_rule``, from matrices of ``value``, ``_pos`` (the place in the period) and ``i``."""
    (x, null), (place, _) = m["value"], m["_pos"]
    if x.shape[1] < max(2 * period, 8):
        no = np.ones(x.shape, bool)
        return {n: (np.zeros(x.shape) if k == "double" else np.full(x.shape, None, object), no) for n, k in made.items()}
    x = x.astype(float)
    expected, unknown = groups.medians_by(place, x, null)
    residual = x - expected
    middle, _ = groups.median(residual, null)
    off = np.abs(residual - middle[:, None])
    mad, none = groups.median(off, null)
    mean = np.where(null, 0.0, off).sum(axis=1) / np.maximum((~null).sum(axis=1), 1)
    by_mad, by_mean = mad / MAD_TO_SIGMA, mean / MEAN_ABS_TO_SIGMA
    # NaN stands above all numbers
    use_mad = ~none & ~(mad <= 0) & ~(by_mad < min_scale)
    use_mean = ~none & (mad == 0) & ~(by_mean < min_scale)
    scale = np.where(use_mad, by_mad, np.where(use_mean, by_mean, min_scale))
    z = (residual - middle[:, None]) / scale[:, None]
    found = {"expected": (expected, unknown), "residual": (residual, null), "robust_z": (z, null)}
    if "method" in made:
        method = np.where(use_mad, "mad", np.where(use_mean, "mean_abs_dev", "floor")).astype(object)
        found["method"] = np.repeat(method[:, None], x.shape[1], axis=1)
    if "twins" in made:
        found["twins"] = _twins(m["i"][0], z, null)
    return {n: found[n] for n in made}


def _twins(place: np.ndarray, z: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At points whose place (in order) is taken more than once: the z of all points there."""
    out, none = np.full(z.shape, None, object), np.ones(z.shape, bool)
    again = place[:, 1:] == place[:, :-1]
    for row in np.flatnonzero(again.any(axis=1)):
        for p in np.unique(place[row, 1:][again[row]]):
            at = np.flatnonzero(place[row] == p)
            for j in at:
                out[row, j], none[row, j] = [None if null[row, k] else float(z[row, k]) for k in at], False
    return out, none


def seasonal_residuals(series: DataFrame, period: int, min_scale: float = 1.0, together: bool = False) -> DataFrame:
    """``expected, residual, robust_z, method`` of every point; keys too short for the rule are left out."""
    found = residual_rule(series.select("key", "i", "value"), period, min_scale, together)
    return found.where(F.col("method").isNotNull())


def lagged(series: DataFrame, rows: int, default: float = 0.0, together: bool = False) -> DataFrame:
    """``series`` with the values of so many points before; ``default`` where there is none."""
    def compute(m: groups.Matrices) -> dict:
        x, null = m["value"]
        moved, gone = np.full(x.shape, default), np.zeros(x.shape, bool)
        moved[:, rows:], gone[:, rows:] = x[:, : max(0, x.shape[1] - rows)], null[:, : max(0, x.shape[1] - rows)]
        return {"_moved": (moved, gone)}

    found = groups.in_groups(series, "key", "i", ["value"], {"_moved": "double"}, compute, together)
    return found.select(*[F.col("_moved" if c == "value" else c).alias(c) for c in series.columns])


def residual_scales(series: DataFrame, period: int, min_scale: float = 1.0) -> DataFrame:
    """The robust residual scale per key with its method."""
    expected = cycle_profile(series, period, "median")
    resid = series.withColumn("position", F.pmod("i", F.lit(period))).join(expected, ["key", "position"]).select(
        "key", (F.col("value") - F.col("level")).alias("residual")
    )
    half = F.lit(0.5)
    centres = resid.groupBy("key").agg(F.percentile("residual", half).alias("_med"))
    spread = resid.join(centres, "key").groupBy("key").agg(
        F.percentile(F.abs(F.col("residual") - F.col("_med")), half).alias("_mad"),
        F.avg(F.abs(F.col("residual") - F.col("_med"))).alias("_abs"),
    )
    scale, method = scale_of(F.col("_mad"), F.col("_abs"), min_scale)
    return spread.select("key", scale.alias("scale"), method.alias("method"))


def seasonal_anomalies(series: DataFrame, period: int, k: float = 3.5, min_scale: float = 1.0, together: bool = False) -> DataFrame:
    """Points whose robust z is at least ``k`` in size, with direction."""
    return seasonal_residuals(series, period, min_scale, together).where(F.abs("robust_z") >= k).withColumn(
        "direction", F.when(F.col("robust_z") > 0, "spike").otherwise("drop")
    )


def top_anomalies(found: DataFrame, n: int = 20) -> DataFrame:
    return found.orderBy(F.desc(F.abs(F.round("robust_z", 2))), "key", "i").limit(n)
