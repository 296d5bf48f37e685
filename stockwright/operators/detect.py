"""Anomaly detection on the signal panel: features, isolation forest, injected anomalies and scoring.

The signal panel is ``(sku_id, day, i, demand, on_hand, receipts)`` with one row per item and axis day.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import groups
from ..functions.numeric import uniforms
from ..functions.ranks import largest
from ..session import cut, stored
from . import series as se

STRONG = 3.0
TREES, SAMPLES = 200, 8192
#: Values of a digit of 16 bits.
DIGITS = 1 << 16
#: Days before and after that a rolling median reads.
HALF = 3
KINDS = ["spike", "drop", "shrinkage"]
DIRECTIONS = ["spike", "drop", "other"]


# --- features --------------------------------------------------------------------------------------


def rolling_median(value: str, half: int = HALF) -> Column:
    """Centred rolling median by item; the first and last values are repeated beyond the ends."""
    w = Window.partitionBy("sku_id").orderBy("i")
    whole = Window.partitionBy("sku_id")
    near = F.collect_list(value).over(w.rowsBetween(-half, half))
    first, last = F.min("i").over(whole), F.max("i").over(whole)
    head = F.greatest(F.lit(0), F.lit(half) - (F.col("i") - first)).cast("int")
    tail = F.greatest(F.lit(0), F.lit(half) - (last - F.col("i"))).cast("int")
    start = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    end = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.sort_array(F.concat(near, F.array_repeat(start, head), F.array_repeat(end, tail)))[half]


def weekday_median(panel: DataFrame, value: str, together: bool = False) -> DataFrame:
    """The panel with ``weekday_median``: the item's median of ``value`` on the same weekday."""
    def compute(m: groups.Matrices) -> dict:
        return {"weekday_median": groups.medians_by(_weekdays(m), m[value][0].astype(float), m[value][1])}

    placed = panel.withColumn("_day", F.weekday("day"))
    return groups.in_groups(placed, "sku_id", "i", [value, "_day"], {"weekday_median": "double"}, compute, together).drop("_day")


def _weekdays(m: groups.Matrices) -> np.ndarray:
    return np.where(m["_day"][1], -1, m["_day"][0]).astype(int)


def _balance(m: groups.Matrices) -> tuple[np.ndarray, np.ndarray]:
    """Stock change that neither receipts nor demand explain; 0 on the first day and for rounding noise."""
    (stock, no_stock), (got, no_got), (sold, no_sold) = m["on_hand"], m["receipts"], m["demand"]
    gap, null = np.zeros(stock.shape), np.zeros(stock.shape, bool)
    gap[:, 1:] = stock[:, 1:] - stock[:, :-1] - got[:, 1:] + sold[:, 1:]
    null[:, 1:] = ~no_stock[:, :-1] & (no_stock | no_got | no_sold)[:, 1:]  # a day after one without stock starts anew
    gap[:, 1:][no_stock[:, :-1]] = 0.0
    return np.where(np.abs(gap) < 1e-6, 0.0, gap), null


def stock_balance(panel: DataFrame, together: bool = False) -> DataFrame:
    """The panel with ``balance``: stock change that neither receipts nor demand explain."""
    return groups.in_groups(panel, "sku_id", "i", ["demand", "on_hand", "receipts"], {"balance": "double"}, lambda m: {"balance": _balance(m)}, together)


def signal_features(panel: DataFrame, together: bool = False) -> DataFrame:
    """Scaled demand features and missing stock per item and day, an item's days worked on at once.  ``together``: its rows
    follow each other already."""
    return groups.in_groups(_filled(panel), "sku_id", "i", INPUTS, MADE, _features, together, ["sku_id", "day", "i", "demand"])


def packed_features(panel: DataFrame | groups.Packed) -> groups.Packed:
    """``signal_features`` without the demand, in blocks."""
    held = panel if isinstance(panel, groups.Packed) else groups.packed(panel.select(*PANEL), "sku_id")

    def filled(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        day = groups._flat(table, "day")
        columns = {c: groups._flat(table, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("demand", "on_hand", "receipts")}
        made = {**{c: pa.array(np.where(np.isnan(x), 0.0, x)) for c, x in columns.items()}, "_day": pc.day_of_week(day)}
        return pa.table([*[groups._flat(table, c) for c in PLACE], *made.values()], [*PLACE, *made]), groups.starts_of(table, "sku_id")

    fields = [*held.select(*PLACE).fields, *MADE.items()]
    return held.pack(lambda tables: groups.computed(map(filled, tables), "i", INPUTS, PLACE, MADE, _features), fields)


def _filled(panel: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return panel.select(
        "sku_id", "day", "i", *[F.coalesce(F.nanvl(F.col(c).cast("double"), zero), zero).alias(c) for c in ("demand", "on_hand", "receipts")],
        F.weekday("day").alias("_day"),
    )


def _features(m: groups.Matrices) -> dict:
    x, known = m["demand"]
    spread = np.maximum(x.std(axis=1), 1.0)[:, None]
    mean = np.maximum(x.mean(axis=1), 1e-9)[:, None]
    weekday, _ = groups.medians_by(_weekdays(m), x, known)
    wide = np.concatenate([np.repeat(x[:, :1], HALF, axis=1), x, np.repeat(x[:, -1:], HALF, axis=1)], axis=1)
    near = np.lib.stride_tricks.sliding_window_view(wide, 2 * HALF + 1, axis=1)
    rolling = np.partition(near, HALF, axis=2)[:, :, HALF]
    return {"level": (x - np.median(x, axis=1)[:, None]) / spread, "weekday": (x - weekday) / spread, "rolling": (x - rolling) / spread,
            "is_zero": (x == 0).astype(float), "missing": np.minimum(_balance(m)[0], 0.0) / mean}


FEATURES = ["level", "weekday", "rolling", "is_zero", "missing"]
INPUTS = ["demand", "on_hand", "receipts", "_day"]
MADE = {c: "double" for c in FEATURES}
PLACE = ["sku_id", "day", "i"]
PANEL = [*PLACE, "demand", "on_hand", "receipts"]


# --- isolation forest ------------------------------------------------------------------------------


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One isolation tree in heap layout: split feature (-1 at a leaf), threshold, path length of a leaf.

    Grown a level at a time: the rows of a level are sorted by node and every node split at once.
    """
    size = 2 ** (depth + 1) - 1
    feature = np.full(size, -1, dtype=np.int16)
    threshold = np.zeros(size, dtype=np.float64)
    length = np.zeros(size, dtype=np.float32)
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for level in range(depth + 1):
        if not len(rows):
            break
        order = np.argsort(node, kind="stable")
        node, rows = node[order], rows[order]
        nodes, starts, counts = np.unique(node, return_index=True, return_counts=True)
        low, high = np.minimum.reduceat(x[rows], starts, axis=0), np.maximum.reduceat(x[rows], starts, axis=0)
        draw = np.where(high > low, rng.random(high.shape), -1.0)
        pick = draw.argmax(axis=1)
        each = np.arange(len(nodes))
        leaf = (draw[each, pick] < 0) | (counts <= 1) | (level == depth)
        length[nodes[leaf]] = level + _average_path(counts[leaf])
        at = low[each, pick] + rng.random(len(nodes)) * (high[each, pick] - low[each, pick])
        feature[nodes[~leaf]], threshold[nodes[~leaf]] = pick[~leaf], at[~leaf]
        place = np.repeat(each, counts)
        stay = ~leaf[place]
        right = x[rows, pick[place]] > at[place]
        node, rows = (2 * node + 1 + right)[stay], rows[stay]
        # a node whose rows all went one way leaves an empty child: path length of nothing
        children = np.concatenate([2 * nodes[~leaf] + 1, 2 * nodes[~leaf] + 2])
        if level < depth:
            length[children] = level + 1
    return feature, threshold, length


def tree_samples(features: groups.Packed, rows: int, columns: list[str], trees: int = TREES, samples: int = SAMPLES, seed: int = 0) -> DataFrame:
    """About ``samples`` rows per tree, by one rule for all sizes: a row's hash says in how many trees it is (on
    average its share of all samples), and from where and by which stride it goes round the trees, each at most once."""
    wanted = min(1.0, samples / max(rows, 1)) * trees
    strides = np.array([k for k in range(1, max(trees, 2)) if math.gcd(k, trees) == 1])

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for table in tables:
            count = np.minimum(np.floor(wanted + uniforms(seed, "tree.count", *_keys(table))).astype(int), trees)
            table, count = table.filter(pa.array(count > 0)), count[count > 0]
            first = np.floor(uniforms(seed, "tree.first", *_keys(table)) * trees).astype(int)
            stride = strides[np.floor(uniforms(seed, "tree.stride", *_keys(table)) * len(strides)).astype(int)]
            row = np.repeat(np.arange(len(count)), count)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            tree = (first[row] + turn * stride[row]) % trees
            yield table.select(columns).take(pa.array(row)).add_column(0, "tree", pa.array(tree.astype(np.int32)))

    return features.give(run, [("tree", "int"), *[(c, "double") for c in columns]])


def _keys(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    return groups._flat(table, "sku_id"), groups._flat(table, "i")


def grow_forest(features: groups.Packed, columns: list[str] = FEATURES, trees: int = TREES, samples: int = SAMPLES, seed: int = 0):
    """A fitted forest: arrays of a fixed size (trees x nodes), whatever the data."""
    rows = features.count()
    size = min(samples, rows)
    depth = max(1, math.ceil(math.log2(max(size, 2))))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[columns].to_numpy(float)
        x = x[np.lexsort(x.T)]  # the tree does not depend on the order rows arrive in
        f, t, h = _complete(*_grow(x, np.random.default_rng([seed, int(key[0])]), depth), depth)
        return pd.DataFrame({"tree": [int(key[0])], "f": [f.tobytes()], "t": [t.tobytes()], "h": [h.tobytes()], "n": [len(x)]})

    grown = tree_samples(features, rows, columns, trees, samples, seed).groupBy("tree").applyInPandas(
        one, "tree int, f binary, t binary, h binary, n int"
    ).toPandas().sort_values("tree")
    f, t, h = ([np.frombuffer(x, kind) for x in grown[c]] for c, kind in (("f", np.int8), ("t", np.float64), ("h", np.float32)))
    return {"f": f, "t": t, "h": h, "depth": depth, "scale": float(_average_path(float(grown.n.mean()))), "columns": columns}


def _complete(feature: np.ndarray, threshold: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same tree with all its leaves on the last level: split features and thresholds above it, path lengths on it.
    Below an early leaf every row goes left."""
    feature, threshold, length = feature.astype(np.int8), threshold.copy(), length.copy()
    for level in range(depth):
        nodes = np.arange(2**level - 1, 2 ** (level + 1) - 1)
        leaf = nodes[feature[nodes] < 0]
        feature[leaf], threshold[leaf] = 0, np.inf
        feature[2 * leaf + 1], length[2 * leaf + 1] = -1, length[leaf]
    return feature[: 2**depth - 1], threshold[: 2**depth - 1], length[2**depth - 1 :]


def _paths(x: np.ndarray, forest: dict) -> np.ndarray:
    """The summed path lengths of the rows of ``x`` in all trees."""
    n, depth = len(x), forest["depth"]
    values, base, path = np.ascontiguousarray(x).ravel(), np.arange(n) * x.shape[1], np.zeros(n)
    node, at, right = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, bool)
    value, border = np.empty(n), np.empty(n)
    for f, t, h in zip(forest["f"], forest["t"], forest["h"]):
        f = f.astype(np.int64)
        node.fill(0)
        for _ in range(depth):
            f.take(node, out=at, mode="clip")
            at += base
            values.take(at, out=value, mode="clip")
            t.take(node, out=border, mode="clip")
            np.greater(value, border, out=right)
            node <<= 1
            node += 1
            node += right
        node -= 2**depth - 1
        path += h.take(node)
    return path


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``x``, and which of them each row is: told apart by a hash, and by value where that fails."""
    h = np.zeros(len(x), np.uint64)
    for column in range(x.shape[1]):
        h = (h ^ (x[:, column] + 0.0).view(np.uint64)) * np.uint64(0x9E3779B185EBCA87)
        h ^= h >> np.uint64(29)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    if np.array_equal(x[first][place], x):
        return x[first], place
    rows, place = np.unique(x, axis=0, return_inverse=True)
    return rows, place.ravel()


def forest_scores(features: groups.Packed, forest: dict) -> groups.Packed:
    """``score`` of every row, larger is more anomalous: 2 ** -(mean path / expected path)."""
    shared = features.blocks.sparkSession.sparkContext.broadcast(forest)

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        fo = shared.value
        for table in tables:
            # days of one item share many feature rows (no sale, no residual): each distinct row is scored once
            x = np.column_stack([groups._flat(table, c).to_numpy(zero_copy_only=False) for c in fo["columns"]])
            rows, place = _distinct(x)
            score = np.power(2.0, -(_paths(rows, fo) / len(fo["f"])) / fo["scale"])[place]
            yield table.append_column("score", pa.array(score, from_pandas=True))  # not a number: NULL

    return features.pack(run, [*features.fields, ("score", "double")])


def place_of(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the numbers ``x``, as SQL has it: -0 equals 0, NaN stands above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits | np.int64(-1 << 63)).view(np.uint64)


def value_at(held: groups.Packed, values: Callable[[pa.Table], np.ndarray], rank: int) -> tuple[float, int, int]:
    """The number at 0-based ``rank`` in ascending order, of those that ``values`` gives for the tables, how many are smaller,
    and how many equal it.  Found by its digits (16 bits each), counted in one reading of the blocks each."""
    known, below = 0, 0
    for digit in (3, 2, 1, 0):
        def count(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
            n = np.zeros(DIGITS, np.int64)
            for table in tables:
                place = place_of(values(table))
                if digit < 3:
                    place = place[place >> np.uint64(16 * digit + 16) == np.uint64(known)]
                n += np.bincount((place >> np.uint64(16 * digit) & np.uint64(DIGITS - 1)).astype(np.int64), minlength=DIGITS)
            yield pa.table({"digit": np.flatnonzero(n), "n": n[n > 0]})

        counts = held.give(count, [("digit", "bigint"), ("n", "bigint")]).groupBy("digit").agg(F.sum("n").alias("n")).collect()
        for value, n in sorted(tuple(r) for r in counts):
            if rank < below + n:
                known = known << 16 | value
                break
            below += n
        else:
            raise ValueError(f"no value at rank {rank}")
    bits = np.array([known], np.uint64).view(np.int64)
    return float(np.where(bits >= 0, ~bits, bits & np.int64((1 << 63) - 1)).view(np.float64)[0]), below, n


def isolation_forest(panel: DataFrame | groups.Packed, contamination: float = 0.01, trees: int = TREES, samples: int = SAMPLES, seed: int = 0):
    """``(scores, detections)``: the top ``contamination`` share flagged, with reasons and direction; scores are packed where the panel is."""
    features = packed_features(panel).stored("features")
    scored = forest_scores(features, grow_forest(features, FEATURES, trees, samples, seed)).stored("scores")
    n = scored.count()

    def known(table: pa.Table) -> np.ndarray:
        return groups._flat(table, "score").drop_null().to_numpy(zero_copy_only=False)

    border, _, _ = value_at(scored.select("score"), known, max(0, min(n - 1, math.floor((n - 1) * (1 - contamination)))))
    found = scored.rows(lambda table: _values(table, "score") > border)
    demand_strength = F.greatest(F.abs("level"), F.abs("weekday"), F.abs("rolling"))
    stock_strength = F.abs("missing") * STRONG
    strong = F.array_compact(F.array(
        F.when(demand_strength >= STRONG, "demand"), F.when(stock_strength >= STRONG, "on_hand")
    ))
    strongest = F.array(F.when(demand_strength >= stock_strength, "demand").otherwise("on_hand"))
    found = found.withColumn("reasons", F.when(F.size(strong) > 0, strong).otherwise(strongest))
    way = F.when(
        F.array_contains("reasons", "demand") & (F.col("weekday") != 0),
        F.when(F.col("weekday") > 0, "spike").otherwise("drop"),
    ).otherwise("other")
    scores = scored.select(*PLACE, "score")
    return scores if isinstance(panel, groups.Packed) else scores.rows(), found.select("sku_id", "day", "i", "score", way.alias("direction"), "reasons")


# --- rules and guards ------------------------------------------------------------------------------


def seasonal_detector(panel: DataFrame | groups.Packed, k: float = 3.5, period: int = 7, together: bool = False):
    """``(scores, detections)`` of the seasonal residual rule on every item and day; scores are packed where the panel is."""
    if isinstance(panel, groups.Packed):
        held = _seasonal_scores(panel, period).stored("residuals")
        scores, high = held.select(*PLACE, "score"), held.rows(lambda table: ~(_values(table, "score") < k))
    else:
        rows = panel.select(F.col("sku_id").alias("key"), "i", F.coalesce("demand", F.lit(0.0)).alias("value"), "day")
        placed = F.col("key").isNotNull() & F.col("i").isNotNull()  # a day of no item, or no day, has no score
        each = F.when(placed & F.col("twins").isNotNull(), F.col("twins")).otherwise(F.array(F.when(placed, F.col("robust_z"))))
        # a day that an item has more than once is paired with the score of each of its rows
        high = se.residual_rule(rows, period, together=together, twins=True, kept=["key", "i", "day"], given=("robust_z",)).select(
            F.col("key").alias("sku_id"), "day", "i", F.explode(each).alias("robust_z")).withColumn("score", F.coalesce(F.abs("robust_z"), F.lit(0.0)))
        scores = high.drop("robust_z")
    flagged = high.where(F.abs("robust_z") >= k).select(
        "sku_id", "day", "i", F.round("score", 2).alias("score"),
        F.when(F.col("robust_z") > 0, "spike").otherwise("drop").alias("direction"), F.array(F.lit("demand")).alias("reasons"),
    )
    return scores, flagged


def _values(table: pa.Table, name: str) -> np.ndarray:
    return groups._flat(table, name).to_numpy(zero_copy_only=False)


def _seasonal_scores(panel: groups.Packed, period: int) -> groups.Packed:
    """``robust_z`` of the residual rule and ``score`` of every item and day, as ``seasonal_detector`` finds them in rows."""
    made = {"robust_z": "double", "twins": "array<double>"}

    def placed(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        place = pa.array(np.mod(_values(table, "i"), period))
        value = groups._flat(table, "demand").cast(pa.float64()).fill_null(0.0)
        return table.select(PLACE).append_column("value", value).append_column("_pos", place), groups.starts_of(table, "sku_id")

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for found in groups.computed(map(placed, tables), "i", ["value", "_pos", "i"], PLACE, made, lambda m: se.rule(m, period, 1.0, made)):
            known = pc.and_(groups._flat(found, "sku_id").is_valid(), groups._flat(found, "i").is_valid())
            z, twins = pc.if_else(known, groups._flat(found, "robust_z"), None), pc.if_else(known, groups._flat(found, "twins"), None)
            n = pc.list_value_length(twins).fill_null(1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            again = twins.is_valid().to_numpy(zero_copy_only=False)[row]
            z = pc.replace_with_mask(z.take(pa.array(row)), pa.array(again), twins.flatten())
            score = pc.abs(z).fill_null(0.0)
            yield found.select(PLACE).take(pa.array(row)).append_column("robust_z", z).append_column("score", score)

    return panel.pack(run, [*panel.select(*PLACE).fields, ("robust_z", "double"), ("score", "double")])


def guard(scores: DataFrame, detections: DataFrame, panel: DataFrame) -> DataFrame:
    """What is wrong with a detector's answer, in one row: all zeros when it may be used."""
    grid = panel.select("sku_id", "day")
    keys = ["sku_id", "day"]

    def unfit(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    def count(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    return detections.agg(
        F.count_if(unfit("score")).alias("bad_detections"),
        F.count_if(~F.coalesce(F.col("direction").isin(DIRECTIONS), F.lit(False))).alias("bad_directions"),
    ).select(
        count(grid.join(scores, keys, "left_anti")).alias("missing_scores"),
        count(scores.where(unfit("score"))).alias("bad_scores"),
        count(detections.join(grid, keys, "left_anti")).alias("outside"), "bad_detections", "bad_directions",
    )


def in_order(detections: DataFrame) -> DataFrame:
    """Detections by score, item and day, as one distributed sort."""
    return detections.orderBy(F.desc("score"), "sku_id", "day")


def top_k(scores: DataFrame | groups.Packed, k: int) -> DataFrame:
    """The k item-days of highest score; ties go to the smaller item, then the earlier day."""
    if not isinstance(scores, groups.Packed):
        return largest(stored(scores, "scores"), "score", k, ["sku_id", "day"])
    total = scores.count()
    if k >= total:
        return scores.rows()
    if k <= 0:
        return scores.rows().limit(0)

    def known(table: pa.Table) -> np.ndarray:
        return groups._flat(table, "score").drop_null().to_numpy(zero_copy_only=False)

    border, below, equal = value_at(scores.select("score"), known, total - k)
    place = place_of(np.array([border]))

    def at(table: pa.Table, above: bool) -> np.ndarray:
        found = place_of(_values(table, "score"))
        return (found > place if above else found == place) & groups._flat(table, "score").is_valid().to_numpy(zero_copy_only=False)

    tied = scores.rows(lambda table: at(table, False)).orderBy("sku_id", "day").limit(k - (total - below - equal))
    return scores.rows(lambda table: at(table, True)).unionByName(tied)


# --- injected anomalies ----------------------------------------------------------------------------


def inject(panel: DataFrame | groups.Packed, rate: float = 0.01, kinds: list[str] = KINDS, seed: int = 7):
    """The panel with anomalies on ``rate`` of its item-days; ``kind`` names each, NULL elsewhere.

    Places are the smallest hashes among days >= 1 of items with demand; kinds follow in turn along an item's
    days from a hashed start.  Changes are sequential within an item, whose rows are its axis days.  The result is
    written, and packed where the panel is.
    """
    if not 0.001 <= rate <= 0.05:
        raise ValueError(f"a rate of {rate} lies outside 0.1 % to 5 %")
    unknown = [k for k in kinds if k not in KINDS]
    if unknown or not kinds or len(set(kinds)) != len(kinds):
        raise ValueError(f"name each kind of anomaly once, out of {', '.join(KINDS)}; this is {kinds}")
    if isinstance(panel, groups.Packed):
        rows = panel.select(*PANEL).stored("signals")
    else:
        signals = panel.select(*PLACE, *[F.col(c).cast("double").alias(c) for c in ("demand", "on_hand", "receipts")])
        rows = groups.packed(signals, "sku_id").stored("signals")

    def may(table: pa.Table) -> np.ndarray:
        """Days from 1 on of items with demand."""
        starts = groups.starts_of(table, "sku_id")
        sold = np.add.reduceat(groups._flat(table, "demand").fill_null(0.0).to_numpy(zero_copy_only=False), starts)
        day = groups._flat(table, "i").fill_null(0).to_numpy(zero_copy_only=False)
        return (day >= 1) & np.repeat(~(sold <= 0), np.diff(np.r_[starts, table.num_rows]))

    def draws(table: pa.Table, most: float) -> np.ndarray:
        u = uniforms(seed, "inject", *_keys(table))[may(table)]
        return u[u <= most]

    days = rows.select("sku_id", "i", "demand")
    open_days = days.give(lambda tables: (pa.table({"n": [int(may(t).sum())]}) for t in tables), [("n", "bigint")]).agg(F.sum("n")).first()[0] or 0
    count, border = min(open_days, round(rate * rows.count())), -1.0
    for most in (min(1.0, 1.2 * count / open_days + 1e-4), 1.0) if count else ():  # hashes are uniform: the place is among the smallest
        near = days.pack(lambda tables: (pa.table({"u": draws(t, most)}) for t in tables), [("u", "double")]).stored("draws")
        if near.count() >= count:
            border = value_at(near, lambda table: _values(table, "u"), count - 1)[0]
            break

    def drawn(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        sku, i = _keys(table)
        chosen = (uniforms(seed, "inject", sku, i) <= border) & may(table)
        at = pa.array(np.flatnonzero(chosen))
        sizes = {"_t": uniforms(seed, "inject.start", sku), "_a": np.zeros(len(chosen)), "_b": np.zeros(len(chosen))}
        for n, stream in (("_a", "inject.size"), ("_b", "inject.again")):
            sizes[n][chosen] = uniforms(seed, stream, sku.take(at), i.take(at))
        for n, x in (("_chosen", chosen), *sizes.items()):
            table = table.append_column(n, pa.array(x))
        return table, groups.starts_of(table, "sku_id")

    def compute(m: groups.Matrices) -> dict:
        chosen = m["_chosen"][0].astype(bool)
        demand, stock, code = changed(m["demand"][0], m["on_hand"][0], np.nan_to_num(m["receipts"][0]), chosen, (m["_t"][0][:, 0] * len(kinds)).astype(int),
                                      m["_a"][0], m["_b"][0], kinds)
        return {"_sold": (demand, np.isnan(demand)), "_stock": (stock, np.isnan(stock)), "kind": np.array([*kinds, None], dtype=object)[code]}

    made = {"_sold": "double", "_stock": "double", "kind": "string"}
    inputs, names = ["demand", "on_hand", "receipts", "_chosen", "_t", "_a", "_b"], [*PLACE, "receipts"]
    shown = {"_sold": "demand", "_stock": "on_hand"}

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for table in groups.computed(map(drawn, tables), "i", inputs, names, made, compute):
            yield table.rename_columns([shown.get(n, n) for n in table.column_names])

    found = rows.pack(run, [*rows.select(*names).fields, *[(shown.get(n, n), k) for n, k in made.items()]]).stored("injected")
    if isinstance(panel, groups.Packed):
        return found
    return found.rows().select(F.col("sku_id").cast("string"), "day", F.col("i").cast("bigint"), "receipts", "demand", "on_hand", "kind")


def changed(demand: np.ndarray, stock: np.ndarray, receipts: np.ndarray, chosen: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray,
            kinds: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Demand, stock (NaN: not known) and kind numbers (-1: none) of items x days after all changes.

    The first chosen place of every item is changed at once, then the second, and so on: a change reads the stock that
    the item's earlier ones left.  A spike sells more and takes what stock allows; a drop sells nothing and leaves the
    goods in stock; shrinkage takes stock alone.  Where a drop has nothing to drop, or shrinkage too little to take, a
    spike takes its turn, if spikes are asked for.
    """
    demand, stock, code = demand.copy(), stock.copy(), np.full(demand.shape, -1)
    number = {kind: kinds.index(kind) if kind in kinds else len(kinds) for kind in KINDS}
    usual, turn_of, days = demand.mean(axis=1), np.cumsum(chosen, axis=1), np.arange(demand.shape[1])
    for turn in range(1, int(turn_of[:, -1].max(initial=0)) + 1):
        item = np.flatnonzero(turn_of[:, -1] >= turn)
        day = (turn_of[item] < turn).sum(axis=1)
        kind = (start[item] + turn - 1) % len(kinds)
        from_here = days >= day[:, None]
        least = np.where(from_here, stock[item], np.inf).min(axis=1)
        known = ~np.isnan(stock[item, day])
        spiky = kind == number["spike"]
        size = (np.where(spiky, 3, 2) + 3 * a[item, day]) * usual[item]
        unfit = (kind == number["drop"]) & (demand[item, day] <= 0)
        unfit |= (kind == number["shrinkage"]) & (~known | (least < size))
        size = np.where(unfit, (3 + 3 * b[item, day]) * usual[item], size)
        kind = np.where(unfit, number["spike"], kind)
        spike, drop, loss = (kind == number[k] for k in ("spike", "drop", "shrinkage"))
        sold = demand[item, day]
        back = np.minimum(sold, stock[item, np.maximum(day - 1, 0)] + receipts[item, day])
        move = np.select([spike & known, drop & known, loss], [-np.minimum(size, least), back, -size], 0.0)
        stock[item] += np.where(from_here, move[:, None], 0.0)
        demand[item, day] = np.select([spike, drop], [sold + size, 0.0], sold)
        done = kind < len(kinds)
        code[item[done], day[done]] = kind[done]
    return demand, stock, code


# --- scoring ---------------------------------------------------------------------------------------


def match(flagged: DataFrame, injected: DataFrame) -> DataFrame:
    """Places flagged, injected or both: ``(sku_id, day, kind, flagged, injected)``."""
    left = flagged.select("sku_id", "day", F.lit(True).alias("flagged"))
    right = injected.select("sku_id", "day", "kind", F.lit(True).alias("injected"))
    return left.join(right, ["sku_id", "day"], "full").fillna(False, ["flagged", "injected"])


def detection_scores(flagged: DataFrame, injected: DataFrame) -> DataFrame:
    """Precision, recall and F1 per kind and for ``all``; a kind's precision counts its hits and all false alarms."""
    both = match(flagged, injected)
    hit = F.col("flagged") & F.col("injected")
    per = both.groupingSets([["kind"], []], "kind").agg(
        F.grouping("kind").alias("_all"), F.count_if(hit).alias("hits"), F.count_if("injected").alias("places"),
        F.count_if(F.col("flagged") & ~F.col("injected")).alias("_false"),
    ).where((F.col("_all") == 1) | F.col("kind").isNotNull())
    per = cut(per)  # a row per kind; the places are joined once
    false_alarms = per.where(F.col("_all") == 1).agg(F.max("_false").alias("n")).scalar()
    shaped = per.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("kind")).alias("kind"), "hits", "places",
        (F.col("hits") + false_alarms).alias("flagged"),
    )
    p, q = F.try_divide("hits", "flagged"), F.try_divide("hits", "places")
    f1 = F.when(p + q > 0, 2 * p * q / (p + q)).when(p.isNotNull() & q.isNotNull(), F.lit(0.0))
    return shaped.select("kind", p.alias("precision"), q.alias("recall"), f1.alias("f1"), "flagged", "hits", "places")


def score_detectors(panel: DataFrame | groups.Packed, detectors: dict[str, Callable[[DataFrame | groups.Packed], tuple[DataFrame, DataFrame]]]) -> DataFrame:
    """Every detector on an injected panel, at its own threshold and at its top k (k = places injected).

    A detector is any function from the panel to ``(scores, detections)``; one that fails becomes an error row.  Detectors
    of a packed panel get it packed, and may give their scores so.
    """
    if isinstance(panel, groups.Packed):
        places = panel.select("sku_id", "day", "kind").rows(lambda table: groups._flat(table, "kind").is_valid().to_numpy(zero_copy_only=False))
    else:
        places = panel.where(F.col("kind").isNotNull()).select("sku_id", "day", "kind")
    injected = cut(places)
    k = injected.count()
    out = None
    for name, run in detectors.items():
        try:
            scores, found = run(panel.drop("kind"))
            parts = [("threshold", detection_scores(found, injected)), ("top-k", detection_scores(top_k(scores, k), injected))]
            rows = [p.select(F.lit(name).alias("detector"), F.lit(c).alias("cut"), "*", F.lit(None).cast("string").alias("error")) for c, p in parts]
        except ValueError as problem:
            nothing = F.lit(None).cast("double")
            rows = [injected.sparkSession.range(1).select(
                F.lit(name).alias("detector"), F.lit("threshold").alias("cut"), F.lit("all").alias("kind"),
                *[nothing.alias(c) for c in ("precision", "recall", "f1")],
                *[nothing.cast("bigint").alias(c) for c in ("flagged", "hits", "places")], F.lit(str(problem)).alias("error"))]
        for row in rows:
            out = row if out is None else out.unionByName(row)
    return out
