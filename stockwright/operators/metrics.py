"""Forecast error measures: point errors and probabilistic scores, one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio


def quantile_name(level: float) -> str:
    """0.1 -> q10, 0.025 -> q2_5."""
    return "q" + f"{level * 100:g}".replace(".", "_")


def point_errors(pairs: DataFrame, keys: list[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """MAE, RMSE, bias, MAPE (positive actuals only) and WAPE; the last two NULL where undefined."""
    a, p = F.col(actual), F.col(pred)
    total = F.sum(a)
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(p - a)).alias("mae"),
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        F.avg(p - a).alias("bias"),
        F.avg(F.when(a > 0, F.try_divide(F.abs(p - a), a))).alias("mape"),
        F.when(total > 0, ratio(F.sum(F.abs(p - a)), total)).alias("wape"),
    )


def pinball(level: float) -> Column:
    gap = F.col("actual") - F.col(quantile_name(level))
    return F.greatest(F.lit(level) * gap, F.lit(level - 1.0) * gap)


def _sums(levels: list[float]) -> list[Column]:
    gap = F.abs(F.col("actual") - F.col("mean"))
    lo, hi = F.col(quantile_name(levels[0])), F.col(quantile_name(levels[-1]))
    loss = sum([pinball(lv) for lv in levels[1:]], pinball(levels[0])) / F.lit(float(len(levels)))
    a = F.col("actual")
    return [
        F.sum(a).alias("_total"), F.sum(gap).alias("_abs"), F.sum(F.col("mean") - a).alias("_diff"),
        F.avg(gap).alias("mae"), F.avg(loss).alias("pinball"),
        F.avg(((a > lo) & (a < hi)).cast("double")).alias("coverage_open"),
        F.avg(((a >= lo) & (a <= hi)).cast("double")).alias("coverage_closed"),
        F.avg(hi - lo).alias("width"),
    ]


def forecast_scores(forecasts: DataFrame, levels: list[float], reference: str = "seasonal-naive") -> DataFrame:
    """Scores per forecaster and per (forecaster, days ahead) in one pass; ``days_ahead`` 0 is the whole.

    ``forecasts``: ``(forecaster, k, actual, mean, q..)`` and must hold the reference forecaster, whose
    absolute error is the yardstick of ``relative``.
    """
    levels = sorted(levels)
    both = forecasts.groupingSets([["forecaster"], ["forecaster", "k"]], "forecaster", "k").agg(
        *_sums(levels), F.when(F.grouping("k") == 1, F.lit(0)).otherwise(F.col("k") + 1).cast("bigint").alias("days_ahead")
    ).drop("k")
    # a few rows: forecasters x (horizon + 1)
    yard = both.where(F.col("forecaster") == reference).select("days_ahead", F.col("_abs").alias("_ref"))
    sold = F.col("_total") > 0
    interval = len(levels) >= 2
    nothing = F.lit(None).cast("double")
    return both.join(yard, "days_ahead", "left").select(
        "forecaster", "days_ahead",
        F.when(sold, ratio(F.col("_abs"), F.col("_total"))).alias("wape"),
        F.when(sold & (F.col("_ref") > 0), ratio(F.col("_abs"), F.col("_ref"))).alias("relative"),
        F.when(sold, ratio(F.col("_diff"), F.col("_total"))).alias("bias"),
        "mae", "pinball",
        *[(F.col(c) if interval else nothing).alias(c) for c in ("coverage_open", "coverage_closed")],
        (F.lit(levels[-1] - levels[0]) if interval else nothing).alias("nominal"),
        (F.col("width") if interval else nothing).alias("width"),
    )
