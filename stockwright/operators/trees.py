"""Gradient-boosted histogram trees for several losses at once, grown by one scan of the rows per tree level.

Rows are binned once (borders from mergeable quantile sketches) and equal rows become one with a weight.  Many models grow
side by side: one per loss, and per training window where rows become known one after another.  A scan sends each model's
sums per node, feature and bin from every task, adds them by model, and returns only the chosen splits.  A last scan per
tree fills the leaves: a Newton step for the Poisson loss; for the pinball loss the quantile of the leaf's residuals, read
from a mergeable sketch (a histogram over logarithmic bins of the residual, ``ACCURACY`` relative error).

The driver holds the trees, whose number and depth are parameters.  Scores of finished trees are kept with the rows, in the
shared checkpoint folder, every ``REFRESH`` trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, prepare

BINS = 32
#: Training weight that each side of a split must hold.
LEAST = 20.0
ACCURACY = 0.02
#: Residuals below this share of the largest target count as zero.
FINEST = 1e-5
REFRESH = 2
#: Distinct rows in a block, and blocks in a task.
BLOCK_ROWS = 1 << 14
TASK_BLOCKS = 6
#: A Newton step never moves a logarithm farther.
LONGEST_STEP = 2.0
LOGISTIC = "logistic"


@dataclass(frozen=True)
class Spec:
    """One model: the Poisson loss (``level`` None), the pinball loss of a level, or the logistic loss (``level`` "logistic",
    targets 0 and 1), on rows of windows up to ``window``, or, where ``without`` is given, on those of all other windows."""

    level: float | str | None
    window: int = 0
    without: int | None = None

    def used(self, first: np.ndarray):
        """The places of its rows among rows in order of their windows."""
        if self.without is not None:
            return np.flatnonzero(first != self.without)
        return slice(0, int(np.searchsorted(first, self.window, side="right")))


@dataclass
class Tree:
    """A complete binary tree: split feature and highest bin of the left side by node (feature -1: all go left), and leaves."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    leaf: np.ndarray | None = None

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The place inside level ``levels`` of every column of ``bins`` (features x rows)."""
        n = bins.shape[1]
        flat, row = bins.reshape(-1), np.arange(n)
        # a node without a split sends all to the left: no bin is above 255
        feature, highest = np.maximum(self.feature, 0) * n, np.where(np.array(self.feature) < 0, 255, self.bin)
        place = np.zeros(n, np.int64)
        for level in range(levels):
            node = place + ((1 << level) - 1)
            place = 2 * place + (flat.take(feature.take(node) + row) > highest.take(node))
        return place


@dataclass
class Ensemble:
    """Fitted models: the borders of the bins, and for each model its trees (the first is a single leaf)."""

    features: list[str]
    borders: list[np.ndarray]
    specs: list[Spec]
    trees: list[list[Tree]]
    depth: int

    def trained(self, window: int) -> bool:
        """Was there any demand to learn from in this window?"""
        return all(np.isfinite(t[0].leaf[0]) for s, t in zip(self.specs, self.trees) if s.window == window)

    def scores(self, bins: np.ndarray, which: Sequence[int], since: int = 0) -> np.ndarray:
        """Models x rows: the sums of the leaves of all trees from number ``since`` on."""
        out = np.zeros((len(which), bins.shape[1]))
        for at, m in enumerate(which):
            for tree in self.trees[m][since:]:
                if tree.leaf is not None:
                    out[at] += tree.leaf[tree.nodes(bins, (len(tree.leaf) - 1).bit_length())]
        return out

    def predicted(self, values: np.ndarray, which: Sequence[int]) -> np.ndarray:
        """Models x rows of ``values`` (rows x features)."""
        return self.linked(binned(values, self.borders), which)

    def linked(self, bins: np.ndarray, which: Sequence[int]) -> np.ndarray:
        """``predicted`` of rows already binned (features x rows)."""
        out = self.scores(bins, which)
        for at, m in enumerate(which):
            if self.specs[m].level is None:
                out[at] = np.exp(out[at])
            elif self.specs[m].level == LOGISTIC:
                out[at] = 1 / (1 + np.exp(-out[at]))
        return out


def binned(values: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Features x rows: how many borders are below each value; a value that is not known lies in the lowest bin."""
    known = np.nan_to_num(values, nan=-np.inf)
    return np.stack([np.searchsorted(b, known[:, f]) for f, b in enumerate(borders)]).astype(np.uint8)


def borders_of(rows: DataFrame, features: list[str], bins: int, target: str, window: str, lowest: int = 0) -> tuple[float | None, float, list[np.ndarray]]:
    """The least target, the largest in absolute value of the lowest window, and at most ``bins - 1`` borders per feature with about equally many rows of
    that window between them: one aggregate over all rows, two where no row lies in window 0."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    here = F.col(window) == lowest
    found = rows.agg(F.min(window), F.min(target), F.max(F.when(here, F.abs(F.col(target)))), *[F.percentile_approx(F.when(here, F.col(f).cast("double")), probs, 2000) for f in features]).first()
    if found[0] is not None and found[0] != lowest:
        return borders_of(rows, features, bins, target, window, found[0])
    return found[1], float(found[2] or 0.0), [np.unique(np.array(x or [], float)) for x in found[3:]]


def _blocks(rows: DataFrame, features: list[str], target: str, window: str, borders: list[np.ndarray], models: int) -> DataFrame:
    """Blocks of distinct binned rows with their weights, and scores of zero."""
    width = len(features)

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in range(width)])
            y, first = (b.column(width + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            packed = np.empty((b.num_rows, width + 9), np.uint8)
            packed[:, :width] = binned(values, borders).T
            packed[:, width] = first
            packed[:, width + 1 :] = np.ascontiguousarray(y, np.float64).view(np.uint8).reshape(-1, 8)
            row = pa.Array.from_buffers(pa.binary(width + 9), b.num_rows, [None, pa.py_buffer(packed)])
            same = pa.table([row.cast(pa.binary())], ["row"]).group_by("row").aggregate([([], "count_all")])
            yield from same.select(["row", "count_all"]).rename_columns(["row", "n"]).to_batches()

    columns = [*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y"), F.col(window).cast("int").alias("first")]
    distinct = cut(rows.select(*columns).mapInArrow(bin_rows, "row binary, n bigint").groupBy("row").agg(F.sum("n").alias("n")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                data = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, width + 9)
                order = np.argsort(data[:, width], kind="stable")  # a window's rows come first
                data = data[order]
                y = np.ascontiguousarray(data[:, width + 1 :]).view(np.float64).ravel()
                yield pa.RecordBatch.from_pydict({
                    "bins": [np.ascontiguousarray(data[:, :width].T).tobytes()], "first": [data[:, width].tobytes()], "y": [y.tobytes()],
                    "w": [part.column(1).to_numpy().astype(np.float64)[order].tobytes()], "scores": [np.zeros((models, len(y)), np.float32).tobytes()]})

    parts = max(1, -(-distinct.count() // (BLOCK_ROWS * TASK_BLOCKS)))
    spark = rows.sparkSession
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    try:
        return cut(distinct.repartition(parts, "row").mapInArrow(pack, "bins binary, first binary, y binary, w binary, scores binary"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def _opened(b: pa.RecordBatch, width: int, models: int) -> Iterator[tuple[np.ndarray, ...]]:
    for bins, first, y, w, scores in zip(*[c.to_pylist() for c in b.columns]):
        y = np.frombuffer(y)
        yield (np.frombuffer(bins, np.uint8).reshape(width, -1), np.frombuffer(first, np.uint8), y, np.frombuffer(w),
               np.frombuffer(scores, np.float32).reshape(models, len(y)))


def _slopes(level: float | str | None, y: np.ndarray, score: np.ndarray, finest: float) -> tuple[np.ndarray, np.ndarray]:
    """Downward slope of the loss in each row's score, and its curvature.

    The pinball loss is smoothed over the width of the sketch's bins: many rows equal their score in counts, and a step
    there would give all of them one slope.
    """
    if level is None:
        mean = np.exp(np.clip(score, -30, 30))
        return y - mean, mean
    if level == LOGISTIC:
        share = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return y - share, np.maximum(share * (1 - share), 1e-12)
    width = ACCURACY * np.maximum(np.abs(y), np.abs(score)) + finest
    return np.clip(level - 0.5 + (y - score) / (2 * width), level - 1, level), np.ones(len(y))


def _merged(sent: DataFrame, tasks: int, done, schema: str) -> list:
    """``done(model, parts)`` for what the tasks sent for each model, added up in tasks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, object] = {}
        for b in batches:
            for m, *rest in zip(*[c.to_pylist() for c in b.columns]):
                held[m] = done.add(held.get(m), rest)
        for m, total in held.items():
            yield done.row(m, total)

    gathered = sent.repartition(tasks, "model") if tasks > 1 else sent.coalesce(1)
    return gathered.mapInArrow(run, schema).collect()


class _Splits:
    """Sums of slopes, curvatures and weights by node, feature and bin, and the best split of each node."""

    def __init__(self, nodes: int, width: int, bins: int, least: float):
        self.shape, self.least = (3, nodes, width, bins), least

    def add(self, held, rest):
        new = np.frombuffer(rest[0]).reshape(self.shape)
        return new.copy() if held is None else np.add(held, new, out=held)

    def row(self, m: int, total: np.ndarray) -> pa.RecordBatch:
        left = total.cumsum(axis=3)
        whole = left[:, :, :1, -1:]
        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1]
        fits = (left[2] >= self.least) & (right[2] >= self.least) & np.isfinite(gain)
        # equal gains differ in their last digits with the order of the sums: rounded, the first one is taken
        scale = np.maximum(np.abs(whole[0] ** 2 / np.maximum(whole[1], 1e-300)), 1e-9)
        gain = np.where(fits & (gain > 1e-9 * scale), gain, 0)
        flat = np.array([[float(f"{g:.8g}") for g in node] for node in gain.reshape(gain.shape[0], -1)])
        best = flat.argmax(axis=1)
        feature = np.where(flat.max(axis=1) > 0, best // self.shape[3], -1)
        return pa.RecordBatch.from_pydict({"model": [m], "feature": [feature.tolist()], "bin": [(best % self.shape[3]).tolist()]})


class _Leaves:
    """Leaf values: Newton steps from sums, or quantiles from sketches of residuals."""

    def __init__(self, specs: list[Spec], leaves: int, finest: float, first: bool):
        self.specs, self.leaves, self.finest, self.first = specs, leaves, finest, first
        self.base = np.log1p(ACCURACY)

    def sketch(self, residual: np.ndarray, leaf: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.abs(residual)
        code = np.where(size > self.finest, np.ceil(np.log(np.maximum(size, self.finest) / self.finest) / self.base), 0).astype(np.int64)
        key, place = np.unique((leaf << 32) + (1 << 31) + np.where(residual < 0, -code, code), return_inverse=True)
        return key, np.bincount(place, weights=w, minlength=len(key))

    def add(self, held, rest):
        keys, values = np.frombuffer(rest[0], np.int64), np.frombuffer(rest[1])
        if held is None:
            return keys, values
        both, place = np.unique(np.r_[held[0], keys], return_inverse=True)
        return both, np.bincount(place, weights=np.r_[held[1], values], minlength=len(both))

    def row(self, m: int, total) -> pa.RecordBatch:
        keys, values = total
        out = np.zeros(self.leaves)
        level = self.specs[m].level
        if not isinstance(level, float):
            sums = np.zeros(2 * self.leaves)
            sums[keys] = values
            slope, curve = sums[: self.leaves], sums[self.leaves :]
            if self.first and level == LOGISTIC:  # at score 0 the share is a half, the curvature a quarter of the rows
                share = 0.5 + slope[0] / (4 * curve[0])
                out[0] = np.log(share / (1 - share)) if 0 < share < 1 else -np.inf
            elif self.first:  # at score 0 the mean is 1
                out[0] = np.log((slope[0] + curve[0]) / curve[0]) if slope[0] + curve[0] > 0 else -np.inf
            else:
                there = curve > 0
                out[there] = np.clip(slope[there] / curve[there], -LONGEST_STEP, LONGEST_STEP)
        else:
            leaf = keys >> 32
            for at in np.unique(leaf):
                mine = leaf == at
                upto = np.cumsum(values[mine])
                code = (keys[mine] & 0xFFFFFFFF) - (1 << 31)
                c = code[np.searchsorted(upto, level * upto[-1])]
                out[at] = np.sign(c) * self.finest * np.exp((abs(c) - 0.5) * self.base) if c else 0.0
        return pa.RecordBatch.from_pydict({"model": [m], "leaf": [out.tolist()]})


def fit(rows: DataFrame, features: list[str], target: str, specs: list[Spec], window: str | None = None, trees: int = 100, rate: float = 0.1,
        depth: int = 5, bins: int = BINS, least: float = LEAST) -> Ensemble:
    """Boosted trees of every spec.  ``window``: the first window a row belongs to; a model of window j learns from all rows
    whose window is j or lower, and the bins' borders come from rows of the lowest, so that nothing later is read.

    Rows without a target are left out; features that are NULL lie in the lowest bin.  A Poisson model without any positive
    target, or any model without rows, is not trained: its first leaf is not finite.  Targets below 0 are refused where a
    model has the Poisson loss.
    """
    if depth < 1 or trees < 1 or not 2 <= bins <= 256 or not 0 < rate <= 1:
        raise ValueError("trees and depth are at least 1, bins 2 to 256, and the rate lies in (0, 1]")
    if any(isinstance(s.level, float) and not 0 < s.level < 1 for s in specs):
        raise ValueError("levels lie strictly between 0 and 1")
    spark: SparkSession = prepare(rows.sparkSession)
    known = rows.where(F.col(target).isNotNull()).withColumn("_window", F.col(window) if window else F.lit(0))
    models, width = len(specs), len(features)
    least_target, top, borders = borders_of(known, features, bins, target, "_window")
    if any(s.level is None for s in specs) and (least_target or 0) < 0:
        raise ValueError("the Poisson loss takes no negative targets")
    model = Ensemble(features, borders, list(specs), [[] for _ in specs], depth)
    blocks = _blocks(known, features, target, "_window", borders, models)
    finest = max(top * FINEST, 1e-300)
    merging = max(1, min(models, blocks.rdd.getNumPartitions(), 64))  # tasks that add up what the others sent
    done = 0  # trees whose leaves the stored scores hold

    def current(state: Ensemble, bins_, scores, since: int) -> np.ndarray:
        return scores + state.scores(bins_, range(models), since)

    def grow(level: int) -> None:
        sent = spark.sparkContext.broadcast((model, done))
        nodes = 1 << level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, since = sent.value
            total = np.zeros((models, 3, nodes, width, bins))
            for b in batches:
                for bins_, first, y, w, scores in _opened(b, width, models):
                    now = current(state, bins_, scores, since)
                    for m, spec in enumerate(specs):
                        use = spec.used(first)
                        slope, curve = _slopes(spec.level, y[use], now[m][use], finest)
                        weight, node = w[use], state.trees[m][-1].nodes(bins_, level)[use] * bins
                        second_order = not isinstance(spec.level, float)
                        parts = (slope * weight, curve * weight, weight) if second_order else (slope * weight, weight)
                        for f in range(width):
                            key = node + bins_[f, use]
                            for at, part in enumerate(parts):
                                total[m, at, :, f] += np.bincount(key, weights=part, minlength=nodes * bins).reshape(nodes, bins)
                        if not second_order:
                            total[m, 2] = total[m, 1]
            yield pa.RecordBatch.from_pydict({"model": list(range(models)), "stats": [t.tobytes() for t in total]})

        found = _merged(blocks.mapInArrow(run, "model bigint, stats binary"), merging, _Splits(nodes, width, bins, least), "model bigint, feature array<bigint>, bin array<bigint>")
        for r in found:
            model.trees[r["model"]][-1].feature += r["feature"]
            model.trees[r["model"]][-1].bin += r["bin"]
        sent.unpersist()

    def fill(levels: int, factor: float) -> None:
        sent = spark.sparkContext.broadcast((model, done))
        leaves = _Leaves(list(specs), 1 << levels, finest, levels == 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, since = sent.value
            held: list = [None] * models
            for b in batches:
                for bins_, first, y, w, scores in _opened(b, width, models):
                    now = current(state, bins_, scores, since)
                    for m, spec in enumerate(specs):
                        use = spec.used(first)
                        if not len(y[use]):
                            continue
                        leaf = state.trees[m][-1].nodes(bins_, levels)[use]
                        if isinstance(spec.level, float):
                            keys, values = leaves.sketch(y[use] - now[m][use], leaf, w[use])
                        else:
                            slope, curve = _slopes(spec.level, y[use], now[m][use], finest)
                            keys = np.arange(2 << levels)
                            values = np.r_[np.bincount(leaf, slope * w[use], 1 << levels), np.bincount(leaf, curve * w[use], 1 << levels)]
                        held[m] = leaves.add(held[m], (keys.astype(np.int64).tobytes(), values.tobytes()))
            there = [m for m in range(models) if held[m] is not None]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array([held[m][0].tobytes() for m in there], pa.binary()),
                                              pa.array([held[m][1].tobytes() for m in there], pa.binary())], ["model", "keys", "weights"])

        found = {r["model"]: r["leaf"] for r in _merged(blocks.mapInArrow(run, "model bigint, keys binary, weights binary"), merging, leaves, "model bigint, leaf array<double>")}
        for m in range(models):
            none = [-np.inf if levels == 0 else 0.0] * (1 << levels)
            model.trees[m][-1].leaf = np.array(found.get(m, none)) * factor
        sent.unpersist()

    def refresh() -> None:
        nonlocal blocks, done
        sent = spark.sparkContext.broadcast((model, done))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, since = sent.value
            for b in batches:
                made = [current(state, bins_, scores, since).astype(np.float32).tobytes() for bins_, _, _, _, scores in _opened(b, width, models)]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(made, pa.binary())], b.schema.names)

        blocks = cut(blocks.mapInArrow(run, blocks.schema))
        done = len(model.trees[0])

    for t in model.trees:
        t.append(Tree())
    fill(0, 1.0)
    if not any(model.trained(s.window) for s in specs):
        return model
    for number in range(trees):
        if number % REFRESH == 0:
            refresh()
        for t in model.trees:
            t.append(Tree())
        for level in range(depth):
            grow(level)
        fill(depth, rate)
    return model
