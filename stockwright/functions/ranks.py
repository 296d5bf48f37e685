"""Exact running totals and quantiles that never put a whole group into one task.

A window over a group sorts the group in one task, and ``percentile`` holds a group's distinct
values in one buffer.  Where one key may own a third of all rows, these functions split every
group into value ranges instead: sums per range are prefix-summed (a few hundred rows per key)
and added to a running sum inside each range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

RANGES = 256


def split_points(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges - 1`` inner borders with about equally many rows of ``df`` between them."""
    probs = [i / ranges for i in range(1, ranges)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(p) for p in probs]), 4096)).first()
    return sorted(set(row[0] or []))


def _same(left: str, right: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def running_totals(
    df: DataFrame, keys: list[str], value: str, amounts: list[str], ranges: int = RANGES
) -> DataFrame:
    """Per key, in order of ``value``: ``<amount>_before`` (sum over smaller values) and ``<amount>_total``.

    ``df`` holds one row per (keys, value); values are finite numbers.
    """
    points = split_points(df, value, ranges)
    borders = [-float("inf"), *points, float("inf")]
    if len(borders) < 3:
        borders = [-float("inf"), 0.0, float("inf")]
    placed = Bucketizer(splits=borders, inputCol="_as_double", outputCol="_range").transform(
        df.withColumn("_as_double", F.col(value).cast("double"))
    ).drop("_as_double")
    sums = placed.groupBy(*keys, "_range").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    # at most RANGES rows per key are sorted here
    ordered = Window.partitionBy(*keys).orderBy("_range")
    whole = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys,
        "_range",
        *[
            F.coalesce(F.sum(f"_{a}").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_off_{a}")
            for a in amounts
        ],
        *[F.sum(f"_{a}").over(whole).alias(f"{a}_total") for a in amounts],
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"_in_{a}") for a in amounts])
    joined = local.alias("l").join(offsets.alias("o"), _same("l", "o", [*keys, "_range"]), "inner")
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"l._in_{a}") + F.col(f"o._off_{a}")).alias(f"{a}_before") for a in amounts],
        *[F.col(f"o.{a}_total") for a in amounts],
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per key, one column per entry of ``probs``; NULL values are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return quantiles_of_counts(counted, keys, "_value", "_n", probs)


def quantiles_of_counts(
    counted: DataFrame, keys: list[str], value: str, count: str, probs: dict[str, float]
) -> DataFrame:
    """``exact_quantiles`` of data already reduced to one row per (keys, value) with its count."""
    ranked = running_totals(counted, keys, value, [count])
    before, total = F.col(f"{count}_before"), F.col(f"{count}_total")
    last = before + F.col(count) - 1
    aggs, outs = [], []
    for name, p in probs.items():
        place = (total - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        aggs += [
            F.max(F.when((before <= low) & (low <= last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((before <= high) & (high <= last), F.col(value))).alias(f"_hi_{name}"),
            F.max(place - low).alias(f"_fr_{name}"),
        ]
        outs.append(
            (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_fr_{name}")).alias(name)
        )
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def exact_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The median of several columns per key: the columns are melted, so one pass serves all."""
    melted = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_m")
    ).select(*keys, F.col("_m.c").alias("_c"), F.col("_m.v").alias("_v"))
    found = exact_quantiles(melted, [*keys, "_c"], "_v", {"_med": 0.5})
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == c, F.col("_med"))).alias(c) for c in columns])


def value_at_rank(df: DataFrame, value: str, rank: int) -> tuple[float, int, int]:
    """The value at 0-based ``rank`` in ascending order, how many rows are smaller, and how many equal it.

    Approximate quantiles tell between which values it lies; only those are counted one by one, the rest are added up.
    Should it lie outside, all values are counted.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_value"))
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    points, n = known.agg(F.percentile_approx("_value", probs, 4096), F.count(F.lit(1))).first()
    if not 0 <= rank < n:
        raise ValueError(f"no value at rank {rank}")
    near = rank * RANGES // n - 1  # the quantile at or below the rank
    low, high = (points[near - 1] if near >= 1 else None), (points[near + 2] if near + 2 < len(points) else None)
    for low, high in ((low, high), (None, None)):
        some = known if high is None else known.where(F.col("_value") <= F.lit(high))
        inside = F.col("_value") if low is None else F.when(F.col("_value") >= F.lit(low), F.col("_value"))
        counted = cut(some.groupBy(inside.alias("_value")).agg(F.count(F.lit(1)).alias("_n")))  # NULL: all below
        below = counted.where(F.col("_value").isNull()).agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        here = counted.where(F.col("_value").isNotNull())
        if below <= rank < below + here.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]:
            break
    ranked = running_totals(here, [], "_value", ["_n"])
    row = ranked.where((F.col("_n_before") <= rank - below) & (F.lit(rank - below) < F.col("_n_before") + F.col("_n"))).first()
    return float(row["_value"]), int(below + row["_n_before"]), int(row["_n"])


def largest(df: DataFrame, value: str, k: int, ties: list[str]) -> DataFrame:
    """Exactly the ``k`` rows of largest ``value``; ties in the order of ``ties``.  For a k that grows with the
    data: rows above the k-th value pass a filter, only rows equal to it are ordered."""
    total = df.count()
    if k >= total:
        return df
    if k <= 0:
        return df.limit(0)
    border, below, equal = value_at_rank(df, value, total - k)
    above = total - below - equal
    tied = df.where(F.col(value) == F.lit(border)).orderBy(*ties).limit(k - above)
    return df.where(F.col(value) > F.lit(border)).unionByName(tied)


def values_at_ranks(
    draws: DataFrame, pool: DataFrame, keys: list[str], rank: str, value: str, before: str, count: str, width: int = 50_000
) -> DataFrame:
    """For each draw the pool value that covers its 0-based rank: an as-of lookup without a range join.

    ``pool``: one row per (keys, value) with the number of rows before it and its own count.  Ranks are cut into
    pieces of ``width``; a value is placed in every piece it spans, so a value that owns a third of all ranks is
    spread over a third of the pieces, and each piece is one small sort.
    """
    piece = F.floor(F.col(rank) / width)
    left = draws.withColumns({"_g": piece, "_r": F.col(rank).cast("bigint"), "_side": F.lit(1), "_v": F.lit(None).cast("double")})
    spans = F.sequence(F.floor(F.col(before) / width), F.floor((F.col(before) + F.col(count) - 1) / width))
    right = pool.select(*keys, F.col(before).alias("_b"), F.col(value).cast("double").alias("_v"), F.explode(spans).alias("_g")).select(
        *keys, "_g", F.greatest(F.col("_b").cast("bigint"), (F.col("_g") * width).cast("bigint")).alias("_r"), "_v", F.lit(0).alias("_side")
    )
    w = Window.partitionBy(*keys, "_g").orderBy("_r", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_found", F.last("_v", ignorenulls=True).over(w))
    return both.where(F.col("_side") == 1).select(*draws.columns, F.col("_found").alias(value))


#: Rows of a pool that go to the tasks as arrays; larger pools are cut into pieces by ``values_at_ranks``.
POOL = 1 << 16


def looked_up(pool: DataFrame, keys: list[str], value: str, before: str):
    """``values_at_ranks`` as a column function of the keys and the rank, or None where the pool (read twice) has more than ``POOL``
    rows or unknown keys.  Ranks lie below a key's total; a key without rows gives NULL."""
    rows = pool.select(*keys, F.col(before).cast("bigint").alias("_b"), F.col(value).cast("double").alias("_v")).limit(POOL + 1).toPandas()
    if len(rows) > POOL or rows[keys].isna().any(axis=None):
        return None
    known = [pd.Index(rows[k].unique()) for k in keys]
    bits = int(rows["_b"].max()).bit_length() + 1 if len(rows) else 1
    if np.prod([float(len(x)) for x in known]) * 2.0**bits >= 2.0**62:
        return None

    def place(columns: list[pd.Series], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, there = np.zeros(len(rank), np.int64), np.ones(len(rank), bool)
        for index, column in zip(known, columns):
            code = index.get_indexer(column)
            number, there = number * len(index) + code, there & (code >= 0)
        return (number << bits) + np.minimum(rank, (1 << bits) - 1), there

    held, _ = place([rows[k] for k in keys], rows["_b"].to_numpy(np.int64))
    order = np.argsort(held, kind="stable")
    held, values = held[order], rows["_v"].to_numpy(float)[order]

    @F.pandas_udf("double")
    def found(*columns: pd.Series) -> pd.Series:
        rank = columns[-1].fillna(-1).to_numpy(np.int64)
        asked, there = place(list(columns[:-1]), np.maximum(rank, 0))
        at = np.searchsorted(held, asked, side="right") - 1
        there &= (rank >= 0) & (at >= 0)
        if len(held):
            there &= held[np.maximum(at, 0)] >> bits == asked >> bits
            return pd.Series(np.where(there, values[np.maximum(at, 0)], np.nan)).where(there, None)
        return pd.Series(np.full(len(rank), np.nan)).where(there, None)

    return found
