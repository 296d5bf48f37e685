"""Fitted generators: seasonal series, per-column bootstrap, Bayesian network and Gaussian copula tables.

Fitted state is small (profiles, edges, a k x k matrix, a k-node tree) or a DataFrame; samples are hashes of
(seed, row, column), so they do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import groups
from ..functions.numeric import clip, correlation, normal, uniform
from ..functions.ranks import exact_quantiles, looked_up, running_totals, values_at_ranks
from ..session import cut
from .fidelity import melt_columns, mutual_information

KINDS = ("real", "integer", "category")


# --- column kinds ------------------------------------------------------------------------------------


def apply_kinds(sample: DataFrame, fitted: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Integer columns rounded and clipped to the observed whole range, category columns moved to the nearest
    observed value (the lower one on a tie); NaN and NULL stay."""
    if odd := sorted(set(kinds.values()) - set(KINDS)):
        raise ValueError(f"no such kind of column: {', '.join(odd)} (there are {', '.join(KINDS)})")
    whole = [c for c, k in kinds.items() if k == "integer"]
    out = sample
    if whole:
        value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in whole}
        bounds = fitted.agg(*[F.array(F.ceil(F.min(v)), F.floor(F.max(v))).alias(c) for c, v in value.items()]).first()
        for c in whole:
            low, high = bounds[c]
            if low is not None:  # whole numbers between the observed ends, the lowest one where there are none
                inside = clip(F.bround(c), float(low), float(max(low, high)))
                out = out.withColumn(c, F.when(value[c].isNotNull(), inside).otherwise(F.col(c)))
    for c in [c for c, k in kinds.items() if k == "category"]:
        out = nearest_observed(out, fitted, c)
    return out


#: Observed values that tasks look up in an array; more of them are sorted with the sampled ones.
FEW = 4096


def nearest_observed(sample: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """``column`` moved to the nearest value of ``fitted``.  Up to ``FEW`` observed values go to the tasks as an array;
    where there are more, distinct sampled values are looked up once each.

    Sampled and observed distinct values are sorted together in value ranges (no range join, no broadcast);
    each range also sees the last observed value of the ranges before it and the first of those after.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window

    from ..functions.ranks import split_points

    v = F.col(column).cast("double")
    known = fitted.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("x")).distinct()
    if len(few := known.limit(FEW + 1).collect()) <= FEW:
        if not few:
            return sample
        near = _nearest_of(np.sort(np.array([r.x for r in few], float)))(v)
        return sample.withColumn(column, F.when(v.isNotNull() & ~F.isnan(v), near).otherwise(F.col(column)))
    sample = cut(sample)  # read twice: for its distinct values and to be rewritten
    asked = sample.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("x")).distinct()
    both = asked.withColumn("o", F.lit(None).cast("double")).unionByName(known.withColumn("o", F.col("x")))
    points = split_points(both, "x")  # even over sampled and observed values together
    borders = [-float("inf"), *points, float("inf")] if points else [-float("inf"), 0.0, float("inf")]
    placed = Bucketizer(splits=borders, inputCol="x", outputCol="g").transform(both)
    ends = placed.groupBy("g").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))  # at most 256 rows
    row = Window.orderBy("g")
    around = ends.select("g", F.max("hi").over(row.rowsBetween(Window.unboundedPreceding, -1)).alias("pre"),
                         F.min("lo").over(row.rowsBetween(1, Window.unboundedFollowing)).alias("post"))
    up = Window.partitionBy("g").orderBy("x", F.col("o").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    # the same running frame from above: a frame that reaches to the end would be summed anew for every row
    down = Window.partitionBy("g").orderBy(F.desc("x"), F.col("o").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    looked = placed.join(around, "g").withColumns({
        "below": F.coalesce(F.max("o").over(up), F.col("pre")),
        "above": F.coalesce(F.min("o").over(down), F.col("post")),
    }).where(F.col("o").isNull())
    near = F.when(F.col("below").isNull(), F.col("above")).when(F.col("above").isNull(), F.col("below")).when(
        F.col("x") - F.col("below") <= F.col("above") - F.col("x"), F.col("below")).otherwise(F.col("above"))
    answers = looked.select(F.col("x").alias("_x"), near.alias("_near"))
    joined = sample.join(answers, v == F.col("_x"), "left")
    return joined.select(*[F.coalesce("_near", F.col(c)).alias(c) if c == column else F.col(c) for c in sample.columns])


def _nearest_of(values: np.ndarray):
    """A column function: the nearest of ``values`` (sorted), the lower one on a tie."""

    @F.pandas_udf(T.DoubleType())
    def near(x: pd.Series) -> pd.Series:
        asked = x.to_numpy(float)
        at = np.searchsorted(values, asked)  # the first value that is not smaller
        above, below = values[np.minimum(at, len(values) - 1)], values[np.maximum(at - 1, 0)]
        with np.errstate(invalid="ignore"):
            lower = (at == len(values)) | ((at > 0) & (above != asked) & (asked - below <= above - asked))
        return pd.Series(np.where(lower, below, above))

    return near


def check_sample(sample: DataFrame, columns: list[str]) -> DataFrame:
    """Refuse other columns; count values that are not finite numbers, per column."""
    if list(sample.columns) != list(columns):
        raise ValueError(f"the sample has columns {sample.columns}, the fitted table {columns}")
    return sample.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c)
                        for c in columns])


# --- seasonal series ---------------------------------------------------------------------------------


def _cycle(i: np.ndarray, value: np.ndarray, null: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key's profile (0 at places without a value), and the pool of ratios with which of them are NULL."""
    place = np.mod(i, period)
    n = np.bincount(place[~null], minlength=period)
    with np.errstate(invalid="ignore", divide="ignore"):
        level = np.bincount(place[~null], weights=value[~null], minlength=period) / n
        kept = (n[place] > 0) & ~(level[place] <= 0)  # NaN stands above all numbers
        ratio = value[kept] / level[place[kept]]
    order = np.lexsort((ratio, ~null[kept], i[kept]))
    profile = np.where(n > 0, level, 0.0)
    return (profile, ratio[order], null[kept][order]) if kept.any() else (profile, np.ones(1), np.zeros(1, bool))


def fitted_heads(series: DataFrame, period: int, head: Callable[[int], int], together: bool = False) -> DataFrame:
    """``key, profile, pool, n`` of each key's points before place ``head(points of its axis)``, with ``length`` of its axis
    and ``values``, all its points in order.  Keys without such points and NULL keys are left out.

    A task reads its keys' points once and gives a row per key (arrays bounded by the key's time axis); ``together``: a
    key's points follow each other already."""
    kind = series.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups.whole(batches, "key"):
            keys = groups._flat(table, "key").take(pa.array(starts))
            place, column = groups._flat(table, "i").to_numpy(), groups._flat(table, "value")
            value, none = column.to_numpy(zero_copy_only=False), np.asarray(column.is_null())
            at, rows, lists = [], [], ([], [], [])
            for k, (low, high) in enumerate(zip(starts, np.r_[starts[1:], table.num_rows])):
                i, x, null = place[low:high], value[low:high], none[low:high]
                if (i[1:] < i[:-1]).any():
                    order = np.argsort(i, kind="stable")
                    i, x, null = i[order], x[order], null[order]
                length = int(i[-1]) + 1
                use = i < head(length)
                if not use.any():
                    continue
                profile, pool, gone = _cycle(i[use], x[use], null[use], period)
                at.append(k)
                rows.append((int(i[use][-1]) + 1, length))
                for held, new in zip(lists, ((profile, None), (pool, gone), (x, null))):
                    held.append(pa.array(new[0], pa.float64(), mask=new[1]))
            if not at:
                continue
            size = np.array(rows, np.int64)
            made = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, held)], dtype=np.int32), pa.concat_arrays(held)) for held in lists]
            whole = pa.table([keys.take(pa.array(at)), made[0], made[1], pa.array(size[:, 0]), pa.array(size[:, 1]), made[2]], ["key", "profile", "pool", "n", "length", "values"])
            yield from whole.to_batches(256)

    points = series.where(F.col("key").isNotNull() & F.col("i").isNotNull()).select("key", F.col("i").cast("bigint"), F.col("value").cast("double"))
    return groups.clustered(points, "key", together).mapInArrow(
        run, f"key {kind}, profile array<double>, pool array<double>, n bigint, length bigint, values array<double>")


def fit_seasonal(series: DataFrame, period: int, together: bool = False) -> DataFrame:
    """Per key: the cycle's mean profile and the pool of value / profile ratios in series order (arrays bounded by
    the key's time axis)."""
    return fitted_heads(series, period, lambda n: n, together).select("key", "profile", "pool", "n")


def seasonal_draw(period: int, seed: int, i: Column) -> Column:
    """The point of place ``i`` of a fitted key: its profile times a resampled ratio."""
    at = (F.floor(uniform(seed, "seasonal", "key", i) * F.size("pool")) + 1).cast("int")
    return F.element_at("profile", (F.pmod(i, F.lit(period)) + 1).cast("int")) * F.element_at("pool", at)


def sample_seasonal(model: DataFrame, period: int, n: int | None = None, seed: int = 7) -> DataFrame:
    """``(key, i, value)``: profile times a resampled ratio; as many points as were fitted unless ``n`` says."""
    drawn = drawn_heads(model, period, seed, n)
    return drawn.select("key", F.posexplode("drawn").alias("i", "value")).select("key", F.col("i").cast("bigint").alias("i"), "value")


def drawn_heads(model: DataFrame, period: int, seed: int = 7, n: int | None = None) -> DataFrame:
    """``model`` with ``drawn``, the points of ``sample_seasonal`` as an array: the pool is not copied to each of them."""
    points = F.col("n") if n is None else F.lit(n)
    places = F.sequence(F.lit(0).cast("bigint"), points.cast("bigint") - 1)
    return model.withColumn("drawn", F.transform(places, lambda i: seasonal_draw(period, seed, i)))


# --- tables ------------------------------------------------------------------------------------------


def _pool(fitted: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Distinct values per (column, more keys) with their counts and running totals."""
    counted = fitted.groupBy("column", *keys, "value").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counted, ["column", *keys], "value", ["n"])


def _rows(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).withColumnRenamed("id", "row")


def _widen(drawn: DataFrame, columns: list[str]) -> DataFrame:
    return drawn.groupBy("row").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def bootstrap_table(fitted: DataFrame, columns: list[str], kinds: dict[str, str] | None = None, n: int | None = None,
                    jitter: float = 0.05, seed: int = 7) -> DataFrame:
    """Each column resampled on its own, with Gaussian jitter of ``jitter`` x its population std."""
    total = fitted.count()
    n = total if n is None else n
    std = fitted.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    pool = _pool(melt_columns(fitted, columns, []), columns, [])
    names = F.array(*[F.lit(c) for c in columns])
    draws = _rows(fitted, n).withColumn("column", F.explode(names)).withColumn(
        "rank", F.floor(uniform(seed, "bootstrap", "row", "column") * total).cast("bigint"))
    found = values_at_ranks(draws, pool, ["column"], "rank", "value", "n_before", "n")
    sized = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(float(std[c] or 1.0)))])
    moved = found.withColumn("value", F.col("value") + F.lit(jitter) * F.element_at(sized, F.col("column")) * normal(seed, "jitter", "row", "column"))
    out = _widen(moved, columns)
    return (apply_kinds(out, fitted, kinds) if kinds else out).drop("row")


# --- Bayesian network ----------------------------------------------------------------------------------


@dataclass
class Network:
    """A Chow-Liu tree over binned columns: codes and their pools stay DataFrames."""

    columns: list[str]
    parent: list[int | None]
    order: list[int]
    coded: DataFrame
    edges: dict[str, list[float] | None]


def bin_columns(fitted: DataFrame, columns: list[str], kinds: dict[str, str], bins: int = 20) -> tuple[DataFrame, dict]:
    """Bin codes ``b_<column>``: the value itself for category or few-valued columns, else its quantile bin."""
    distinct = fitted.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    cutting = [c for c in columns if kinds.get(c) != "category" and distinct[c] > bins]
    edges: dict[str, list[float] | None] = {c: None for c in columns}
    if cutting:
        probs = {f"q{k}": k / bins for k in range(1, bins)}
        for row in exact_quantiles(melt_columns(fitted, cutting, []), ["column"], "value", probs).collect():  # one row per column
            edges[row.column] = sorted({row[q] for q in probs})
    codes = {}
    for c in columns:
        v = F.col(c).cast("double")
        if edges[c] is None:
            codes[f"b_{c}"] = v
        else:
            codes[f"b_{c}"] = _bin(v, edges[c])
    return fitted.select(*[F.col(c).cast("double").alias(c) for c in columns]).withColumns(codes), edges


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges are at most ``value``."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value)).cast("double")


def spanning_tree(k: int, mi: dict[tuple[int, int], float]) -> tuple[list[int | None], list[int]]:
    """The maximum spanning tree of pairwise mutual information, rooted at column 0; ties to the earlier column."""
    parent: list[int | None] = [None] * k
    order = [0]
    while len(order) < k:
        outside = [j for j in range(k) if j not in order]
        j = max(outside, key=lambda c: (max(mi[tuple(sorted((c, p)))] for p in order), -c))
        parent[j] = max(order, key=lambda p: (mi[tuple(sorted((j, p)))], -order.index(p)))
        order.append(j)
    return parent, order


def fit_network(fitted: DataFrame, columns: list[str], kinds: dict[str, str], bins: int = 20) -> Network:
    coded, edges = bin_columns(fitted, columns, kinds, bins)
    coded = cut(coded)
    bad = coded.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in columns]).first()
    if any(bad):
        raise ValueError("NULL or NaN in a column to be modelled: leave such rows out or fill them before")
    k = len(columns)
    mi = {}
    if k > 1:
        mi = {(r.a, r.b): r.mi for r in mutual_information(coded, [f"b_{c}" for c in columns]).collect()}  # k (k-1) / 2 rows
    parent, order = spanning_tree(k, mi)
    return Network(columns, parent, order, coded, edges)


def conditional_counts(net: Network, j: int) -> DataFrame:
    """``(parent, child, n, n_before, n_total)``: the observed pairs of a parent's and a child's bin, each with its number
    and the running total over the parent's children.  Pairs that don't occur have no row."""
    child = F.col(f"b_{net.columns[j]}").alias("child")
    up = F.lit(0.0).alias("parent") if net.parent[j] is None else F.col(f"b_{net.columns[net.parent[j]]}").alias("parent")
    counts = net.coded.groupBy(up, child).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return cut(running_totals(counts, ["parent"], "child", ["n"]))


def child_ranks(counts: DataFrame) -> DataFrame:
    """``(child, one, one_before, one_total)``: the distinct bins of a child in order, with their places."""
    return running_totals(counts.groupBy("child").agg(F.lit(1.0).alias("one")), [], "child", ["one"])


def conditional_table(net: Network, j: int, smoothing: float = 1.0) -> DataFrame:
    """``(parent, child, cumulative)``: smoothed cumulative probabilities of all child bins under every parent bin.

    Laid out from the sparse counts: every observed pair fills the bins up to the parent's next observed one.
    """
    counts = conditional_counts(net, j)
    ranks = cut(child_ranks(counts))
    placed = counts.join(ranks, "child").select("parent", "n", "n_before", "n_total", F.col("one_before").cast("int").alias("at"), F.col("one_total").cast("int").alias("size"))
    by = Window.partitionBy("parent").orderBy("at")
    start = F.when(F.row_number().over(by) == 1, F.lit(0)).otherwise(F.col("at"))
    stop = F.coalesce(F.lead("at").over(by), F.col("size")) - 1
    filled = placed.withColumns({"_a": start, "_z": stop}).withColumn("place", F.explode(F.sequence("_a", "_z")))
    upto = F.when(F.col("place") >= F.col("at"), F.col("n_before") + F.col("n")).otherwise(0.0)
    share = (upto + smoothing / F.col("size") * (F.col("place") + 1)) / (F.col("n_total") + smoothing)
    names = ranks.select("child", F.col("one_before").cast("int").alias("place"))
    return filled.select("parent", "place", share.alias("cumulative")).join(names, "place").select("parent", "child", "cumulative")


def sample_network(net: Network, fitted: DataFrame, kinds: dict[str, str], n: int, seed: int = 7, smoothing: float = 1.0) -> DataFrame:
    """Bins drawn down the tree, then a real value of each bin.

    A draw falls on the observed children of its parent, by their counts, or, with the weight of the smoothing, on any
    child bin alike: two as-of lookups over running totals, and never the product of all parents and children.
    """
    out = _rows(fitted, n)
    for j in net.order:
        c = net.columns[j]
        counts = conditional_counts(net, j)
        ranks = cut(child_ranks(counts))
        size = F.lit(float(ranks.count()))
        key = F.lit(0.0) if net.parent[j] is None else F.col(f"b_{net.columns[net.parent[j]]}")
        weights = counts.groupBy("parent").agg(F.max("n_total").alias("_t"))
        drawn = out.withColumn("parent", key).join(weights, "parent").withColumn("_w", uniform(seed, f"network.{j}", "row") * (F.col("_t") + smoothing))
        near, any_ = looked_up(counts, ["parent"], "child", "n_before"), looked_up(ranks, [], "child", "one_before")
        if near and any_:  # small pools: both looked up in the row, nothing is shuffled
            total = looked_up(weights.withColumn("_z", F.lit(0)), ["parent"], "_t", "_z")
            put = out.withColumn("_t", total(key, F.lit(0))).withColumn("_w", uniform(seed, f"network.{j}", "row") * (F.col("_t") + smoothing))
            place = F.least(F.floor((F.col("_w") - F.col("_t")) / smoothing * size), size - 1).cast("bigint")
            child = F.when(F.col("_w") < F.col("_t"), near(key, F.floor("_w"))).otherwise(any_(place))
            out = put.withColumn(f"b_{c}", child).drop("_t", "_w")
            continue
        seen = drawn.where(F.col("_w") < F.col("_t")).withColumn("_r", F.floor("_w"))
        other = drawn.where(F.col("_w") >= F.col("_t")).withColumn("_r", F.least(F.floor((F.col("_w") - F.col("_t")) / smoothing * size), size - 1).cast("bigint"))
        found = values_at_ranks(seen, counts, ["parent"], "_r", "child", "n_before", "n").unionByName(
            values_at_ranks(other, ranks, [], "_r", "child", "one_before", "one"))
        out = found.withColumnRenamed("child", f"b_{c}").drop("parent", "_t", "_w", "_r")
    triples = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b_{c}").alias("bin"), F.col(c).alias("value")) for c in net.columns])
    pool = cut(_pool(net.coded.select(F.explode(triples).alias("t")).select("t.*"), net.columns, ["bin"]))
    sizes = pool.groupBy("column", "bin").agg(F.max("n_total").alias("size"))
    value = looked_up(pool, ["column", "bin"], "value", "n_before")
    if value:
        size = looked_up(sizes.withColumn("_z", F.lit(0)), ["column", "bin"], "size", "_z")
        for c in net.columns:
            rank = F.floor(uniform(seed, "network.value", "row", F.lit(c)) * size(F.lit(c), F.col(f"b_{c}"), F.lit(0))).cast("bigint")
            out = out.withColumn(c, value(F.lit(c), F.col(f"b_{c}"), rank))
        return apply_kinds(out.select("row", *net.columns), fitted, kinds).drop("row")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b_{c}").alias("bin")) for c in net.columns])
    draws = out.select("row", F.explode(pairs).alias("p")).select("row", "p.*").join(sizes, ["column", "bin"]).withColumn(
        "rank", F.floor(uniform(seed, "network.value", "row", "column") * F.col("size")).cast("bigint"))
    found = values_at_ranks(draws, pool, ["column", "bin"], "rank", "value", "n_before", "n")
    return apply_kinds(_widen(found, net.columns), fitted, kinds).drop("row")


def bayesian_network_table(fitted: DataFrame, columns: list[str], kinds: dict[str, str], n: int | None = None, bins: int = 20, seed: int = 7) -> DataFrame:
    n = fitted.count() if n is None else n
    return sample_network(fit_network(fitted, columns, kinds, bins), fitted, kinds, n, seed)


# --- Gaussian copula -----------------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def _score(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return pd.Series([inverse(x) for x in p])


@F.pandas_udf(T.DoubleType())
def _share(z: pd.Series) -> pd.Series:
    return pd.Series([0.5 * math.erfc(-x / math.sqrt(2.0)) for x in z])


def gaussian_copula_table(fitted: DataFrame, columns: list[str], kinds: dict[str, str] | None = None, n: int | None = None, seed: int = 7) -> DataFrame:
    """Normal-score correlation (k x k, on the driver) with empirical marginals read at the sampled ranks."""
    total = fitted.count()
    n = total if n is None else n
    pool = cut(_pool(melt_columns(fitted, columns, []), columns, []))
    middle = (F.col("n_before") + (F.col("n") + 1) / 2.0) / (F.col("n_total") + 1.0)
    scores = pool.select("column", "value", _score(middle).alias("z"))
    wide = fitted.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        one = scores.where(F.col("column") == c).select(F.col("value").alias(c), F.col("z").alias(f"z_{c}"))
        wide = wide.join(one, c)
    k = len(columns)
    row = wide.agg(*[correlation(F.col(f"z_{a}"), F.col(f"z_{b}")).alias(f"r{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]).first() if k > 1 else None
    corr = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            r = row[f"r{i}_{j}"]
            corr[i, j] = corr[j, i] = 0.0 if r is None or math.isnan(r) else r
    values, vectors = np.linalg.eigh(corr)
    root = vectors @ np.diag(np.sqrt(np.maximum(values, 0.0)))
    base = _rows(fitted, n).withColumns({f"e{i}": normal(seed, f"copula.{i}", "row") for i in range(k)})
    mixed = [sum([F.lit(float(root[i, j])) * F.col(f"e{j}") for j in range(1, k)], F.lit(float(root[i, 0])) * F.col("e0")) for i in range(k)]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), m.alias("z")) for c, m in zip(columns, mixed)])
    draws = base.select("row", F.explode(pairs).alias("p")).select("row", "p.*").withColumn(
        "rank", F.least(F.floor(_share(F.col("z")) * total), F.lit(total - 1)).cast("bigint"))
    found = values_at_ranks(draws, pool, ["column"], "rank", "value", "n_before", "n")
    out = _widen(found, columns)
    return (apply_kinds(out, fitted, kinds) if kinds else out).drop("row")


TABLE_GENERATORS: dict[str, Callable[..., DataFrame]] = {
    "bootstrap-table": bootstrap_table,
    "bayesian-network": bayesian_network_table,
    "gaussian-copula": gaussian_copula_table,
}
