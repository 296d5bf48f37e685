"""Sums of small vectors over a whole table: each task adds up its rows, Spark adds up the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def vector_sum(df: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum over all Arrow batches of ``fn(batch)``, a vector of fixed ``size`` (p x p for p columns)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += fn(pdf)
        yield pd.DataFrame({"place": np.arange(size), "value": total})

    rows = df.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for row in rows:  # ``size`` rows
        out[row.place] = row.value
    return out
