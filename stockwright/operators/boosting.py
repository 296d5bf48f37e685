"""Global boosted-tree forecaster on lag features of the panel: a mean and quantiles, each from trees of its own loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import groups
from ..functions.numeric import uniform
from ..session import cut
from . import demand as dm
from . import forecast as fc
from . import trees as tr
from .metrics import quantile_name

WINDOW = 28
#: Trees of a model: the rate of 0.1 leaves a hundredth of the first error after about fifty.
TREES = 60
FEATURES = ["last_1", "last_7", "last_14", "mean_7", "mean_28", "zero_share_28", "weekday", "days_ahead"]


def first_sale(panel: DataFrame) -> DataFrame:
    """First selling day per item."""
    return panel.where(F.col("qty") > 0).groupBy("sku_id").agg(F.min("day").alias("first_sale"))


def origin_features(panel: DataFrame, axis: dm.Axis, horizon: int) -> DataFrame:
    """Per item and origin (the first day not seen): what the last 28 days hold, the item's age and the days after.

    Whole items are worked on in tasks as their dense rows come, without windows over them."""
    dense = fc._with_next_day(panel, axis).select("sku_id", "day", F.col("i").cast("bigint"), F.col("qty").cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups.whole(batches, "sku_id"):
            counts = np.diff(np.r_[starts, table.num_rows])
            place = groups._flat(table, "i").to_numpy()
            back = place[1:] < place[:-1]
            back[starts[1:] - 1] = False
            if back.any():
                table = table.take(np.lexsort((place, np.repeat(np.arange(len(starts)), counts))))
                place = groups._flat(table, "i").to_numpy()
            column = groups._flat(table, "qty")
            none = np.asarray(column.is_null())
            x = np.where(none, 0.0, column.to_numpy(zero_copy_only=False))
            first, last = np.repeat(starts, counts), np.repeat(starts + counts, counts)
            at = np.arange(len(x))

            def before(n: int) -> pa.Array:
                from_ = at - n
                gone = from_ < first
                from_ = np.maximum(from_, 0)
                return pa.array(x[from_], mask=gone | none[from_])

            kept = np.flatnonzero(place >= WINDOW)
            plain = not none[at != last - 1].any() and not (at - first < WINDOW)[kept].any()  # rows kept have all days of their windows

            def mean(values: np.ndarray, unknown: np.ndarray, n: int) -> pa.Array:
                total, known = np.zeros(len(x)), np.zeros(len(x), np.int64)
                for back_ in range(n, 0, -1) if plain else ():
                    total[back_:] += values[:-back_]
                if plain:
                    return pa.array(total / n)
                for back_ in range(n, 0, -1):
                    seen = np.flatnonzero((at - back_ >= first) & ~unknown[np.maximum(at - back_, 0)])
                    total[seen] += values[seen - back_]
                    known[seen] += 1
                return pa.array(total / np.maximum(known, 1), mask=known == 0)

            sold = np.flatnonzero(~none & ((x > 0) | np.isnan(x)))
            born = np.full(len(starts), np.iinfo(np.int64).max)
            np.minimum.at(born, np.searchsorted(starts, sold, side="right") - 1, place[sold])
            age = place - np.repeat(born, counts)
            days = kept[:, None] + np.arange(horizon)
            inside = days < last[kept][:, None]
            days = np.minimum(days, len(x) - 1)
            inside &= ~none[days]
            future = pa.ListArray.from_arrays(np.r_[0, np.cumsum(inside.sum(axis=1))].astype(np.int32), pa.array(x[days][inside]))
            whole = [groups._flat(table, c) for c in ("sku_id", "i", "day")] + [before(n) for n in (1, 7, 14)] + [mean(x, none, n) for n in (7, 28)] + [
                mean(((x == 0) & ~none).astype(float), none, 28), pa.array(age, mask=np.repeat(born, counts) == np.iinfo(np.int64).max)]
            out = pa.table([c.take(pa.array(kept)) for c in whole] + [future], names)
            yield from out.to_batches(1 << 14)

    names = ["sku_id", "i", "day", "last_1", "last_7", "last_14", "mean_7", "mean_28", "zero_share_28", "age", "_future"]
    kind = panel.schema["sku_id"].dataType.simpleString()
    doubles = ", ".join(f"{n} double" for n in names[3:9])
    return groups.clustered(dense, "sku_id", together=True).mapInArrow(run, f"sku_id {kind}, i bigint, day date, {doubles}, age bigint, _future array<double>")


def feature_rows(panel: DataFrame, axis: dm.Axis, horizon: int, ahead: list[int] | None = None, shaped: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``origin_features`` (``shaped`` before they are spread) for every number of days ahead, or those of ``ahead``, with the
    weekday aimed at and the target."""
    return ahead_rows(shaped(origin_features(panel, axis, horizon)), horizon, ahead=ahead)


def ahead_rows(rows: DataFrame, horizon: int, *others: str, ahead: list[int] | None = None) -> DataFrame:
    """The rows of ``origin_features`` for every number of days ahead, or those of ``ahead``."""
    asked = F.sequence(F.lit(1), F.lit(horizon)) if ahead is None else F.array(*[F.lit(d) for d in ahead])
    spread = rows.withColumn("days_ahead", F.explode(asked))
    return spread.select(
        "sku_id", "i", *FEATURES[:6], F.weekday(F.date_add("day", F.col("days_ahead") - 1)).alias("weekday"), "days_ahead",
        "age", F.try_element_at("_future", F.col("days_ahead")).alias("target"), *others,
    )


def boosted_models(panel: DataFrame, axis: dm.Axis, origins: list[int], horizon: int, levels: list[float], trees: int = TREES, rate: float = 0.1,
                   depth: int = 5, min_history: int = WINDOW, max_rows: int | None = None, seed: int = 0) -> tuple[DataFrame, tr.Ensemble]:
    """``origin_features`` of all days at which an item is at least ``min_history`` days old, and the models fitted on them.

    For each origin there is a mean model (Poisson loss) and one per level (pinball loss), fitted on all rows whose day
    aimed at lies before the origin.  All of them grow together: a row belongs to the window of the first origin that may
    read it.  ``max_rows``: about so many rows are drawn by a hash of their key and ``seed``; None trains on all.
    """
    rows = cut(origin_features(panel, axis, horizon).where(F.col("age") >= min_history))
    windows = sum((F.col("i") + F.col("days_ahead") - 1 >= o).cast("int") for o in sorted(origins))
    known = ahead_rows(rows, horizon).withColumn("window", windows).where(F.col("window") < len(origins))
    if max_rows is not None:
        share = max_rows / max(1, known.count())
        known = known.where(uniform(seed, "boosting", "sku_id", "i", "days_ahead") < share)
    specs = [tr.Spec(level, j) for j in range(len(origins)) for level in (None, *sorted(levels))]
    return rows, tr.fit(known, FEATURES, "target", specs, "window", trees, rate, depth)


def boosted_forecasts(panel: DataFrame, axis: dm.Axis, origins: list[int], horizon: int, levels: list[float], min_history: int = WINDOW, **options) -> DataFrame:
    """The boosted model in the form of ``forecast.forecasts``, refitted for each origin: the mean from the Poisson model,
    each quantile from the model of its level, floored at 0, crossed quantiles put in order.

    Items younger than ``min_history`` keep the moving average, as do all where the days before an origin hold no demand.
    """
    origins, levels = sorted(origins), sorted(levels)
    rows, model = boosted_models(panel, axis, origins, horizon, levels, min_history=min_history, **options)
    able = [j for j in range(len(origins)) if model.trained(j)]
    number = F.array_position(F.array(*[F.lit(o).cast("bigint") for o in origins]), F.col("i").cast("bigint")) - 1
    asked = ahead_rows(rows.withColumn("window", number.cast("int")).where(F.col("window").isin(able)), horizon, "window")
    names, each = [quantile_name(lv) for lv in levels], 1 + len(levels)
    sent = panel.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in FEATURES])
            window = b.column("window").to_numpy()
            out = np.zeros((each, b.num_rows))
            for j in np.unique(window):
                out[:, window == j] = sent.value.predicted(values[window == j], range(j * each, (j + 1) * each))
            out = np.maximum(out, 0.0)
            out[1:] = np.sort(out[1:], axis=0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("sku_id", "i", "days_ahead", "target")], *[pa.array(x) for x in out]],
                                             ["sku_id", "i", "days_ahead", "target", "mean", *names])

    kind = asked.schema["sku_id"].dataType.simpleString()
    columns = ", ".join(f"{n} double" for n in ("mean", *names))
    made = asked.select("sku_id", F.col("i").cast("bigint"), F.col("days_ahead").cast("bigint"), F.col("target").cast("double"), *FEATURES[:-1], "window").mapInArrow(run, f"sku_id {kind}, i bigint, days_ahead bigint, target double, {columns}")
    boosted = made.select("sku_id", F.lit("gradient-boosting").alias("forecaster"), F.col("i").alias("origin"), (F.col("days_ahead") - 1).alias("k"),
                          F.col("target").alias("actual"), "mean", *names)
    held = fc.intervals(fc.point_paths(panel, axis, origins, horizon, ["moving-average"]), levels, fc.pooled_steps(origins, horizon))
    grown = rows.select("sku_id", F.col("i").cast("bigint").alias("origin")).where(F.col("origin").isin([origins[j] for j in able]))
    young = held.join(grown, ["sku_id", "origin"], "left_anti").withColumn("forecaster", F.lit("gradient-boosting"))
    return boosted.unionByName(young.select(*boosted.columns))
