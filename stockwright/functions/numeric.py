"""Number, hash and special functions (column expressions first, small driver functions last)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T


def half_even(value: Column) -> Column:
    """Round half to even to a whole number."""
    return F.bround(value, 0).cast("bigint")


def clip(value: Column, low, high) -> Column:
    """``value`` limited to [low, high]; NULL stays NULL."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, NULL where the bottom is 0 or NULL."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation aggregate over complete pairs, NULL where a side is constant (``corr`` raises there)."""
    whole = a.isNotNull() & b.isNotNull()
    x, y = F.when(whole, a), F.when(whole, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def uniform(seed: int, stream: str, *keys) -> Column:
    """A uniform number in (0, 1) that depends only on seed, stream and keys, never on partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *keys), 11)
    return (bits.cast("double") + 0.5) * F.lit(2.0**-53)


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_ALL = (1 << 64) - 1


def _turned(x, bits: int):
    if isinstance(x, int):
        return (x << bits | x >> (64 - bits)) & _ALL
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(_P2)
    h = (h ^ h >> np.uint64(29)) * np.uint64(_P3)
    return h ^ h >> np.uint64(32)


def _hash_numbers(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``xxhash64`` of whole numbers (64 bits, or fewer as 32) on top of the hashes ``h``."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (_P1, _P2, _P3, _P4, _P5))
    if x.dtype.itemsize < 8:
        h = h + p5 + np.uint64(4) ^ x.astype(np.int32).view(np.uint32).astype(np.uint64) * p1
        return _mixed(_turned(h, 23) * p2 + p3)
    h = h + p5 + np.uint64(8) ^ _turned(x.astype(np.int64).view(np.uint64) * p2, 31) * p1
    return _mixed(_turned(h, 27) * p1 + p4)


def _hash_text(text: str, h: int) -> int:
    """``xxhash64`` of one text on top of the hash ``h``."""
    data = text.encode()
    n, at = len(data), 0
    if n >= 32:
        v = [h + _P1 + _P2, h + _P2, h, h - _P1]
        while at <= n - 32:
            v = [_turned(x + int.from_bytes(data[at + 8 * k : at + 8 * k + 8], "little") * _P2 & _ALL, 31) * _P1 & _ALL for k, x in enumerate(v)]
            at += 32
        h = sum(_turned(x, bits) for x, bits in zip(v, (1, 7, 12, 18)))
        for x in v:
            h = ((h ^ _turned(x * _P2 & _ALL, 31) * _P1 & _ALL) * _P1 + _P4) & _ALL
    else:
        h += _P5
    h = h + n & _ALL
    while at + 8 <= n:
        h ^= _turned(int.from_bytes(data[at : at + 8], "little") * _P2 & _ALL, 31) * _P1 & _ALL
        h, at = (_turned(h, 27) * _P1 + _P4) & _ALL, at + 8
    if at + 4 <= n:
        h ^= int.from_bytes(data[at : at + 4], "little") * _P1 & _ALL
        h, at = (_turned(h, 23) * _P2 + _P3) & _ALL, at + 4
    for byte in data[at:]:
        h = _turned(h ^ byte * _P5 & _ALL, 11) * _P1 & _ALL
    for bits, by in ((33, _P2), (29, _P3), (32, 1)):
        h = (h ^ h >> bits) * by & _ALL
    return h


def uniforms(seed: int, stream: str, *keys: pa.Array) -> np.ndarray:
    """``uniform`` of texts and whole numbers inside a task: the same numbers."""
    whole = np.array([seed], np.int32 if -(1 << 31) <= seed < 1 << 31 else np.int64)
    h = np.full(len(keys[0]), _hash_text(stream, int(_hash_numbers(whole, np.array([42], np.uint64))[0])), np.uint64)
    for key in keys:
        here = np.asarray(key.is_valid())
        if pa.types.is_integer(key.type):
            hashed = _hash_numbers(key.fill_null(0).to_numpy(zero_copy_only=False), h)
        elif pa.types.is_string(key.type):
            # rows of one text follow each other: texts are hashed where text or hash changes
            code = key.dictionary_encode()
            texts, codes = code.dictionary.to_pylist(), code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
            some = np.array([_hash_text(texts[codes[k]], int(h[k])) if here[k] else 0 for k in new], np.uint64)
            hashed = np.repeat(some, np.diff(np.r_[new, len(h)]))
        else:
            raise TypeError(f"only texts and whole numbers are hashed in a task, not {key.type}")
        h = np.where(here, hashed, h)
    return ((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def normal(seed: int, stream: str, *keys) -> Column:
    """A standard normal number by the Box-Muller transform of two hashed uniforms."""
    radius = F.sqrt(-2.0 * F.ln(uniform(seed, stream + ".r", *keys)))
    return radius * F.cos(2.0 * math.pi * uniform(seed, stream + ".a", *keys))


def sample_key(seed: int, *keys) -> Column:
    """A text key whose order is a seeded random order; the same text in every SQL engine with md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys]).cast("binary"))


@F.pandas_udf(T.IntegerType())
def _poisson(mean: pd.Series, u: pd.Series) -> pd.Series:
    rates, which = np.unique(mean.to_numpy(float), return_inverse=True)
    out = np.zeros(len(mean), dtype=np.int32)
    draws = u.to_numpy(float)
    for i, rate in enumerate(rates):
        if not rate > 0:
            continue
        # in logarithms, from 12 standard deviations below the mean to as many above: nothing underflows to start with
        reach = 12 * math.sqrt(rate) + 40
        k = np.arange(max(0, int(rate - reach)), int(rate + reach) + 1)
        log_factorial = math.lgamma(k[0] + 1) + np.r_[0.0, np.cumsum(np.log(k[1:]))]
        steps = np.cumsum(np.exp(k * math.log(rate) - rate - log_factorial))
        here = which == i
        out[here] = k[0] + np.searchsorted(steps, draws[here], side="left")
    return pd.Series(out)


def poisson(mean: Column, u: Column) -> Column:
    """Poisson draw by inverse CDF from a uniform: the number of cumulative probabilities below ``u``.

    An Arrow batch is searched once per distinct mean; an interpreted loop per row would cost far more.
    """
    return _poisson(mean.cast("double"), u)


def verdict_of_auc(auc: Column) -> Column:
    """The reading of a detection AUC."""
    return (
        F.when(auc < 0.6, "hard to distinguish")
        .when(auc <= 0.8, "distinguishable")
        .otherwise("easily distinguished")
    )


def interval_reading(low: Column, high: Column) -> Column:
    """Whether an interval lies above, below or across 0; an edge at 0 counts as across."""
    return F.when((low <= 0) & (high >= 0), "covers zero").when(low > 0, "above zero").otherwise("below zero")


# --- driver-side special functions (published series and continued fractions) -------------------


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """Standard normal quantile by bisection refined with Newton steps on ``normal_cdf``."""
    if not 0.0 < p < 1.0:
        raise ValueError(f"p must be in (0, 1), got {p!r}")
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        if normal_cdf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        delta = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            delta = c * d
            out *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / 2.0, 0.5, df / (df + x * x))
    return 1.0 - tail if x > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """Student t quantile by bisection on ``t_cdf``."""
    low, high = -1e3, 1e3
    while t_cdf(high, df) < p:
        high *= 10
    while t_cdf(low, df) > p:
        low *= 10
    for _ in range(200):
        mid = (low + high) / 2
        if t_cdf(mid, df) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
