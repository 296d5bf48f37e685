"""Paired effect studies: arms against their baseline, replicate by replicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import t_quantile


def pair_arms(values: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Each arm's value beside the baseline of the same replicate, policy and metric, and the difference."""
    keys = ["replicate", "policy", "metric"]
    base = values.where(F.col("arm") == baseline).select(*keys, F.col("value").alias("base"))
    return values.where(F.col("arm") != baseline).join(base, keys).withColumn("difference", F.col("value") - F.col("base"))


def paired_effects(values: DataFrame, replicates: int, confidence: float = 0.95, baseline: str = "baseline") -> DataFrame:
    """Mean paired difference with a t interval (zero width if all differences are equal); relative to the baseline."""
    t = t_quantile((1 + confidence) / 2, replicates - 1)
    out = pair_arms(values, baseline).groupBy("arm", "policy", "metric").agg(
        F.avg("base").alias("baseline_mean"), F.avg("value").alias("arm_mean"), F.avg("difference").alias("effect"),
        F.stddev_samp("difference").alias("_s"), F.min("difference").alias("_a"), F.max("difference").alias("_b"),
        F.count(F.lit(1)).alias("n"),
    )
    half = F.when(F.col("_a") == F.col("_b"), F.lit(0.0)).otherwise(F.lit(t) * F.col("_s") / F.sqrt(F.col("n").cast("double")))
    return out.withColumns({
        "low": F.col("effect") - half, "high": F.col("effect") + half, "relative": F.try_divide("effect", "baseline_mean"),
    }).drop("_s", "_a", "_b")
