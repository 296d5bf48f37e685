"""How alike two data sets are: distributions, cycles, pair trends, nearest-row privacy, shared histograms."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import correlation, ratio, uniform
from ..functions.ranks import exact_quantiles, running_totals
from ..session import cut

# --- distributions -----------------------------------------------------------------------------------


def ks(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per key (``side`` is 0 = real, 1 = synthetic); 1 if a side is empty.

    Rows are reduced to counts per distinct value; running totals are split by value range.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(
        F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    ranked = running_totals(counts, keys, "_x", ["a", "b"])
    gap = F.abs(ratio(F.col("a_before") + F.col("a"), F.col("a_total")) - ratio(F.col("b_before") + F.col("b"), F.col("b_total")))
    return ranked.groupBy(*keys).agg(F.round(F.coalesce(F.max(gap), F.lit(1.0)), 4).alias("ks"))


def melt_columns(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.column", "_m.value")


def pearson(a: Column, b: Column) -> Column:
    """Correlation aggregate; 0 for fewer than two pairs or a constant side."""
    flat = (F.count(a) < 2) | (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(correlation(a, b), F.lit(0.0)))


def series_fidelity(pairs: DataFrame, period: int) -> DataFrame:
    """Per key: KS, cycle-profile correlation, mean and std change in percent, and the 0..100 score.

    ``pairs``: ``(key, i, side, value)``.
    """
    real = F.col("side") == 0
    moments = pairs.groupBy("key").agg(
        F.avg(F.when(real, F.col("value"))).alias("real_mean"), F.avg(F.when(~real, F.col("value"))).alias("synth_mean"),
        F.stddev_pop(F.when(real, F.col("value"))).alias("_rs"), F.stddev_pop(F.when(~real, F.col("value"))).alias("_ss"))
    cycle = pairs.groupBy("key", F.pmod("i", F.lit(period)).alias("p")).agg(
        F.avg(F.when(real, F.col("value"))).alias("a"), F.avg(F.when(~real, F.col("value"))).alias("b"))
    shape = cycle.groupBy("key").agg(F.round(pearson(F.col("a"), F.col("b")), 4).alias("profile_corr"))
    both = moments.join(shape, "key").join(ks(pairs, ["key"], "value", "side"), "key")
    return both.select(
        "key", "ks", "profile_corr",
        F.round(100 * ratio(F.col("synth_mean") - F.col("real_mean"), F.col("real_mean")), 2).alias("mean_delta_pct"),
        F.round(100 * ratio(F.col("_ss") - F.col("_rs"), F.col("_rs")), 2).alias("std_delta_pct"),
        F.round("real_mean", 2).alias("real_mean"), F.round("synth_mean", 2).alias("synth_mean"),
        F.round(100 * (1 - F.col("ks")) * F.greatest(F.lit(0.0), F.col("profile_corr")), 1).alias("fidelity_score"),
    )


def table_fidelity(both: DataFrame, columns: list[str], pairs: list[tuple[str, str]], side: str = "side") -> DataFrame:
    """One row: mean of ``1 - KS`` over columns, mean of ``1 - |change of correlation| / 2`` over pairs, and their mean."""
    shape = ks(melt_columns(both, columns, [side]), ["column"], "value", side).agg(F.avg(1 - F.col("ks")).alias("s"))
    real = F.col(side) == 0
    trends = []
    for a, b in pairs:
        def corr(flag: Column) -> Column:
            return correlation(F.when(flag, F.col(a).cast("double")), F.when(flag, F.col(b).cast("double")))
        trends.append((1 - F.abs(corr(real) - corr(~real)) / 2).alias(f"{a}~{b}"))
    trend = both.agg(*trends)
    names = [f"`{a}~{b}`" for a, b in pairs]
    mean = sum([F.col(n) for n in names[1:]], F.col(names[0])) / F.lit(float(len(names)))
    return trend.select(*[F.round(n, 4).alias(n.strip("`")) for n in names], F.round(shape.scalar(), 4).alias("column_shape_score"),
                        F.round(mean, 4).alias("pair_trend_score")).withColumn(
        "overall", F.round((F.col("column_shape_score") + F.col("pair_trend_score")) / 2, 4))


def pair_counts(codes: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, ca, cb, n)``: joint counts of every column pair, in one pass over the rows."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(x).alias("ca"), F.col(y).alias("cb"))
        for i, x in enumerate(columns) for j, y in enumerate(columns) if i < j
    ])
    # counts of the distinct code rows first: exploding pairs then multiplies distinct rows, not rows
    whole = codes.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return whole.select(F.explode(pairs).alias("p"), "n").groupBy("p.a", "p.b", "p.ca", "p.cb").agg(F.sum("n").alias("n"))


def mutual_information(codes: DataFrame, columns: list[str]) -> DataFrame:
    """Mutual information of every column pair over bin codes."""
    joint = pair_counts(codes, columns)
    left = joint.groupBy("a", "b", "ca").agg(F.sum("n").alias("na"))
    right = joint.groupBy("a", "b", "cb").agg(F.sum("n").alias("nb"))
    total = joint.groupBy("a", "b").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    part = p * F.ln(F.col("n") * F.col("t") / (F.col("na").cast("double") * F.col("nb")))
    return joint.join(left, ["a", "b", "ca"]).join(right, ["a", "b", "cb"]).join(total, ["a", "b"]).groupBy("a", "b").agg(
        F.sum(part).alias("mi"))


# --- histograms ------------------------------------------------------------------------------------


def shared_histogram(both: DataFrame, column: str, bins: int = 12, side: str = "side") -> DataFrame:
    """Shares of both sides in shared bins: the real 1..99 % range, or one bin per whole number for narrow columns.

    Rows beyond the edges go to the edge bins; the driver holds four numbers.
    """
    value = F.col(column).cast("double")
    real = both.where(F.col(side) == 0)
    row = real.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(value != F.floor(value)).alias("odd")).first()
    if row.odd == 0 and row.hi - row.lo < 24:
        n, low, step = int(row.hi - row.lo) + 1, row.lo - 0.5, 1.0
    else:
        q = exact_quantiles(real.select(value.alias("v")), [], "v", {"a": 0.01, "b": 0.99}).first()
        a, b = (q.a, q.b) if q.b > q.a else (q.a - 0.5, q.b + 0.5)
        n, low, step = bins, a, (b - a) / bins
    place = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((value - F.lit(low)) / F.lit(step)))).cast("int")
    counted = both.where(value.isNotNull()).groupBy(place.alias("bin")).agg(
        F.count_if(F.col(side) == 0).alias("_a"), F.count_if(F.col(side) == 1).alias("_b"))
    sides = both.where(value.isNotNull()).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    axis = both.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return axis.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(step)).alias("low"),
        ratio(F.coalesce("_a", F.lit(0)), sides.select("a").scalar()).alias("real"),
        ratio(F.coalesce("_b", F.lit(0)), sides.select("b").scalar()).alias("synthetic"),
    )


# --- privacy -----------------------------------------------------------------------------------------

#: Points a cell should hold, cells at most (beyond, cells grow), points that the cells' borders are read from.
CELL_ROWS = 8192
CELLS = 4096
SAMPLE_ROWS = 1 << 18
#: Points in a leaf of a cell's own tree, queries of one task and queries compared together.
LEAF_ROWS = 32
BLOCK_ROWS = 4096
TOGETHER = 256


def normalised(both: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 over both sides; a constant column becomes 0."""
    ends = both.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in columns], *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns])
    row = ends.first()
    return both.withColumns({
        c: (F.col(c).cast("double") - F.lit(row[f"lo_{c}"])) / F.lit((row[f"hi_{c}"] - row[f"lo_{c}"]) or 1.0) for c in columns
    })


class Cells:
    """Space cut at medians, the widest side first, until a cell holds about ``rows`` of the points or no side is wide."""

    def __init__(self, points: np.ndarray, rows: int):
        self.side, self.value, self.child, self.parts = [], [], [], []
        self._cut(points, np.arange(len(points)), rows)
        self.flat = np.array(self.side or [0]), np.array(self.value or [0.0]), np.array(self.child or [[0, 0]])

    def _cut(self, points: np.ndarray, inside: np.ndarray, rows: int) -> int:
        """The number of a new node, or -1 minus the number of a new cell."""
        mine = points[inside]
        if len(mine) > rows:
            for side in np.argsort(mine.min(axis=0) - mine.max(axis=0), kind="stable"):
                low, high = mine[:, side].min(), mine[:, side].max()
                if low == high:
                    break
                value = np.partition(mine[:, side], (len(mine) - 1) // 2)[(len(mine) - 1) // 2]
                if value == high:  # more than half of them: the largest value below goes left
                    value = mine[mine[:, side] < high, side].max()
                node = len(self.side)
                self.side.append(int(side))
                self.value.append(float(value))
                self.child.append([0, 0])
                left = mine[:, side] <= value
                self.child[node] = [self._cut(points, inside[left], rows), self._cut(points, inside[~left], rows)]
                return node
        self.parts.append(inside)
        return -len(self.parts)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(points), np.int64) if self.side else np.full(len(points), -1)
        side, value, child = self.flat
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            node = at[open_]
            at[open_] = child[node, (points[open_, side[node]] > value[node]).astype(int)]
            open_ = open_[at[open_] >= 0]
        return -1 - at


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of queries (rows) to boxes (columns); 0 inside."""
    out = np.zeros((len(queries), len(low)))
    for j in range(queries.shape[1]):
        x = queries[:, j][:, None]
        out += np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0) ** 2
    return out


class Boxes:
    """The tight boxes of a tree's cells and of its nodes: finds the cells near a query without looking at all of them."""

    def __init__(self, tree: Cells, cells: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.tree, n = tree, len(tree.side)
        child = np.array(tree.child, np.int64).reshape(n, 2)
        self.child = np.where(child < 0, n - 1 - child, child)  # a node's number, or n + a cell's
        self.low, self.high = np.full((2, n + len(tree.parts), low.shape[1]), np.nan)
        self.low[n + cells], self.high[n + cells] = low, high
        for node in range(n - 1, -1, -1):  # a node's children have larger numbers
            self.low[node] = np.fmin(*self.low[self.child[node]])
            self.high[node] = np.fmax(*self.high[self.child[node]])

    def within(self, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """All (query, cell, squared distance to its box) below the query's squared ``reach``, and how many boxes were looked at."""
        n, looked, found = len(self.child), 0, []
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(query):
            looked += len(query)
            x = queries[query]
            gap = np.zeros(len(query))
            for j in range(x.shape[1]):
                gap += np.maximum(np.maximum(self.low[node, j] - x[:, j], x[:, j] - self.high[node, j]), 0) ** 2
            near = gap < reach[query]
            query, node, gap = query[near], node[near], gap[near]
            leaf = node >= n
            found.append((query[leaf], node[leaf] - n, gap[leaf]))
            query, node = np.repeat(query[~leaf], 2), self.child[node[~leaf]].ravel()
        q, cell, gap = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return q, cell, gap, looked

    def visits(self, queries: np.ndarray, second: np.ndarray, seen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The next ``width`` (query, cell) after the ``seen`` ones: first the query's own cell, then the cells nearer than ``second``, nearest first."""
        home = self.tree.of(queries)
        fresh = np.flatnonzero(seen == 0)
        later = np.flatnonzero(seen > 0)
        q, cell, gap, _ = self.within(queries[later], second[later] ** 2)
        q = later[q]
        other = cell != home[q]
        q, cell, gap = q[other], cell[other], gap[other]
        order = np.lexsort((cell, gap, q))
        q, cell = q[order], cell[order]
        place = np.arange(len(q)) - np.searchsorted(q, q) + 1
        fits = (place >= seen[q]) & (place < seen[q] + width)
        return np.r_[fresh, q[fits]], np.r_[home[fresh], cell[fits]]


def nearest_two(points: np.ndarray, twin: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Squared distances to the two nearest ``points`` (one that is a ``twin`` counts twice), and how many pairs were compared.

    Only leaves whose box is nearer than ``bound`` (squared) and than the second distance found so far are compared.
    """
    tree = Cells(points, LEAF_ROWS)
    size = np.array([len(x) for x in tree.parts])
    begin = np.cumsum(size) - size
    order = np.concatenate(tree.parts)
    points, twin = points[order], twin[order]
    low, high = np.minimum.reduceat(points, begin), np.maximum.reduceat(points, begin)
    best = np.full((len(queries), 2), np.inf)
    compared = 0
    for at in range(0, len(queries), TOGETHER):
        some = queries[at : at + TOGETHER]
        box = box_distances(some, low, high)
        near = best[at : at + TOGETHER]
        for first in (True, False):
            reach = np.minimum(bound[at : at + TOGETHER], near[:, 1])
            here = np.arange(len(low)) == box.argmin(axis=1)[:, None]
            q, leaf = np.nonzero((here if first else ~here) & (box < reach[:, None]))
            n = size[leaf]
            owner = np.repeat(q, n)
            place = np.repeat(begin[leaf] - (np.cumsum(n) - n), n) + np.arange(len(owner))
            d = ((points[place] - some[owner]) ** 2).sum(axis=1)
            compared += len(d)
            again = twin[place]
            owner, d = np.r_[owner, owner[again]], np.r_[d, d[again]]
            ranked = np.lexsort((d, owner))
            owner, d = owner[ranked], d[ranked]
            head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
            second = head[np.diff(np.r_[head, len(owner)]) > 1] + 1
            new = np.full_like(near, np.inf)
            new[owner[head], 0] = d[head]
            new[owner[second], 1] = d[second]
            near[:] = np.sort(np.c_[near, new], axis=1)[:, :2]
    return best[:, 0], best[:, 1], compared


def two_nearest(queries: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distances ``d1 <= d2`` from each distinct query to its two nearest points (both scaled to 0..1).

    ``queries``: distinct rows; ``points``: distinct rows with multiplicity ``n``.  Space is cut at medians into cells of
    about equally many points, by the medians of a bounded sample: dense spots get small cells.  The tight boxes of all
    cells (``CELLS`` at most) are known to every task.  A query goes to its own cell, and then, in rounds of growing width, to
    the nearest of the other boxes that are nearer than its second distance so far; it is done when none is left.  The boxes
    are found down the tree, so that a query's work doesn't grow with the number of cells.
    A cell's queries are dealt to blocks, and inside a cell a tree of small leaves is searched in the same way.  ``d2`` is
    NULL where there is one point only; without points there is no row.
    """
    spark, d = points.sparkSession, len(columns)
    points = cut(points.select(*[F.col(c).cast("double") for c in columns], F.col("n").cast("bigint")))
    size = points.count()
    if not size:
        return queries.select(*[F.col(c).cast("double") for c in columns], F.lit(0.0).alias("d1"), F.lit(0.0).alias("d2")).limit(0)
    share = SAMPLE_ROWS / size
    drawn = points if share >= 1 else points.where(uniform(0, "cells", *columns) < share)
    sample = drawn.select(*columns).toPandas().to_numpy(float)
    tree = Cells(sample, max(1, int(min(1.0, share) * max(CELL_ROWS, size / CELLS))))
    coordinates = ", ".join(f"{c} double" for c in columns)
    sent = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(j).to_numpy() for j in range(d)]) if b.num_rows else np.empty((0, d))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.of(x))], [*b.schema.names, "cell"])

    held = cut(points.mapInArrow(placed, f"{coordinates}, n bigint, cell bigint"))
    box = held.groupBy("cell").agg(*[f(c).alias(f"{k}{j}") for j, c in enumerate(columns) for k, f in (("a", F.min), ("z", F.max))]).orderBy("cell").toPandas()
    cells = box["cell"].to_numpy()
    low, high = (box[[f"{k}{j}" for j in range(d)]].to_numpy(float) for k in "az")
    boxes = spark.sparkContext.broadcast(Boxes(tree, cells, low, high))
    state = f"{coordinates}, d1 double, d2 double, seen bigint"

    def visits(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, TOGETHER):
                    b = whole.slice(at, TOGETHER)
                    x = np.column_stack([b.column(j).to_numpy() for j in range(d)])
                    second, seen = b.column(d + 1).to_numpy(), b.column(d + 2).to_numpy()
                    q, near = boxes.value.visits(x, second, seen, width)
                    none = np.setdiff1d(np.arange(b.num_rows), q)
                    rows = np.r_[q, none]
                    to = np.r_[near, np.full(len(none), -1)]
                    out = pa.Table.from_batches([b]).take(pa.array(rows)).combine_chunks()
                    columns_ = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns]
                    columns_[d + 2] = pa.array((seen[rows] + width).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([*columns_, pa.array(to.astype(np.int64))], [*out.schema.names, "cell"])

        return run

    def search(key: tuple, asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = asked.drop(columns=["cell", "_b"])
        if len(asked) and len(there):
            one, two, _ = nearest_two(there[columns].to_numpy(float), there["n"].to_numpy() > 1, asked[columns].to_numpy(float), asked["d2"].to_numpy(float) ** 2)
            out["e1"], out["e2"] = np.sqrt(one), np.sqrt(two)
        else:
            out["e1"] = out["e2"] = np.inf
        return out

    inf = F.lit(float("inf"))
    open_ = queries.select(*[F.col(c).cast("double") for c in columns], inf.alias("d1"), inf.alias("d2"), F.lit(0).cast("bigint").alias("seen"))
    done, width = None, 1
    while True:
        asked = cut(open_.mapInArrow(visits(width), f"{state}, cell bigint"))
        ready = asked.where("cell = -1").select(*columns, "d1", "d2")
        done = ready if done is None else done.unionByName(ready)
        asked = asked.where("cell >= 0")
        blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_n")).collect()  # a row per cell
        if not blocks:
            finite = lambda c: F.when(F.col(c) < inf, F.col(c)).alias(c)
            return done.select(*columns, finite("d1"), finite("d2"))
        number = F.broadcast(spark.createDataFrame([(r["cell"], r["_n"]) for r in blocks], "cell bigint, _n bigint"))
        left = asked.join(number, "cell").withColumn("_b", F.pmod(F.xxhash64(*columns), F.col("_n"))).drop("_n")
        right = held.join(number, "cell").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).drop("_n")
        left = left.select(*columns, "d1", "d2", "seen", "cell", "_b")
        # fresh column identities: both sides hold the same numbers of blocks
        left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))
        found = left.groupBy("cell", "_b").cogroup(right.groupBy("cell", "_b")).applyInPandas(search, f"{state}, e1 double, e2 double")
        # a query has at most ``width`` rows here
        both = F.array_sort(F.flatten(F.collect_list(F.array("e1", "e2"))))
        merged = found.groupBy(*columns, "d1", "d2", "seen").agg(both.alias("_e")).withColumn("_e", F.array_sort(F.concat(F.array("d1", "d2"), F.slice("_e", 1, 2))))
        open_ = merged.select(*columns, F.col("_e")[0].alias("d1"), F.col("_e")[1].alias("d2"), "seen")
        width = min(4 * width, len(cells))


def nearest_distances(both: DataFrame, columns: list[str], side: str = "side") -> DataFrame:
    """Per distinct synthetic row: multiplicity, distance to the closest real row and to the second closest."""
    scaled = normalised(both, columns)
    reduced = cut(scaled.groupBy(*columns).agg(F.count_if(F.col(side) == 0).alias("n"), F.count_if(F.col(side) == 1).alias("m")))
    asked = reduced.where(F.col("m") > 0)
    return two_nearest(asked, reduced.where(F.col("n") > 0), columns).join(asked.select(*columns, "m"), columns)


def privacy_report(both: DataFrame, columns: list[str], eps: float = 0.02, side: str = "side") -> DataFrame:
    """DCR median and 5 % order statistic, NNDR median, share of near copies and the verdict, over ALL rows."""
    near = cut(nearest_distances(both, columns, side))
    row = near.agg(F.sum("m").alias("n"), F.sum(F.when(F.col("d1") < eps, F.col("m")).otherwise(0)).alias("c")).first()
    nndr = F.when(F.col("d2") > 0, F.col("d1") / F.col("d2")).otherwise(F.lit(1.0))
    each = near.select("m", F.explode(F.array(F.struct(F.lit("dcr").alias("c"), F.col("d1").alias("v")), F.struct(F.lit("nndr").alias("c"), nndr.alias("v")))).alias("x"))
    counted = each.groupBy(F.col("x.c").alias("_c"), F.col("x.v").alias("_v")).agg(F.sum("m").alias("k"))
    n = int(row.n)
    ranks = {(n - 1) // 2, n // 2, max(0, int(0.05 * n) - 1)}
    covers = [(F.col("k_before") <= r) & (F.lit(r) < F.col("k_before") + F.col("k")) for r in sorted(ranks)]
    here = running_totals(counted, ["_c"], "_v", ["k"]).where(functools.reduce(lambda a, b: a | b, covers)).collect()  # a value per rank
    at = {(r["_c"], k): float(r["_v"]) for r in here for k in ranks if r["k_before"] <= k < r["k_before"] + r["k"]}
    dcr, ratio_ = (sum(at[c, m] for m in ((n - 1) // 2, n // 2)) / 2 for c in ("dcr", "nndr"))
    p05 = at["dcr", max(0, int(0.05 * n) - 1)]
    verdict = "low leakage risk" if p05 > eps else "review: some synthetic rows are close to real rows"
    return both.sparkSession.createDataFrame(
        [(n, len(columns), round(dcr, 4), round(p05, 4), round(ratio_, 4), round(100.0 * int(row.c) / n, 2), verdict)],
        "n_synth bigint, dims int, dcr_median double, dcr_p05 double, nndr_median double, clone_risk_pct double, verdict string",
    )
