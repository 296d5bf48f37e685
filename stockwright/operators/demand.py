"""Item-level daily demand: the sparse panel, its axis, profiles, slices and the dense form."""

from __future__ import annotations

from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

INTERMITTENT_SHARE = 0.5


class Axis(NamedTuple):
    """The day axis shared by all items: first day, last day, number of days."""

    first: date
    last: date
    days: int


def kept(orders: DataFrame, include_cancelled: bool = False) -> DataFrame:
    """Order lines that count as demand; cancelled lines are left out unless asked for."""
    return orders if include_cancelled else orders.where(F.col("status") != "cancelled")


def item_day_demand(orders: DataFrame, include_cancelled: bool = False) -> DataFrame:
    """``(sku_id, day, qty)``: summed quantity per item and day; partial sums run before the shuffle."""
    return kept(orders, include_cancelled).groupBy("sku_id", F.to_date("ts").alias("day")).agg(
        F.sum(F.col("quantity").cast("double")).alias("qty")
    )


def axis_row(orders: DataFrame, include_cancelled: bool = False) -> DataFrame:
    """One row ``(first_day, last_day, n)`` over all counted lines; a scan of one column, no shuffle by key."""
    return (
        kept(orders, include_cancelled)
        .agg(F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))
        .withColumn("n", (F.datediff("last_day", "first_day") + 1).cast("bigint"))
    )


def read_axis(orders: DataFrame, include_cancelled: bool = False) -> Axis:
    """The axis row on the driver, for plans that need its length when they are built."""
    row = axis_row(orders, include_cancelled).first()
    if row.first_day is None:
        raise ValueError("no demand: the table has no counted order line")
    return Axis(row.first_day, row.last_day, int(row.n))


def axis_of_panel(panel: DataFrame) -> Axis:
    row = panel.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    return Axis(row.a, row.b, (row.b - row.a).days + 1)


def total_by_day(panel: DataFrame) -> DataFrame:
    """Demand of all items per selling day."""
    return panel.groupBy("day").agg(F.sum("qty").alias("total"))


def active_days(panel: DataFrame) -> DataFrame:
    """Number of days with demand."""
    return total_by_day(panel).agg(F.count_if(F.col("total") > 0).alias("active_days"))


def until(panel: DataFrame, day: date) -> DataFrame:
    """The days before ``day``."""
    return panel.where(F.col("day") < F.lit(day))


def window(panel: DataFrame, axis: Axis, start: date, days: int) -> DataFrame:
    """``days`` days from ``start``; refused when the axis holds fewer."""
    if days < 1:
        raise ValueError(f"a slice of {days} days is empty")
    if not axis.first <= start <= axis.last:
        raise ValueError(f"the axis runs from {axis.first} to {axis.last}; {start} lies outside")
    left = (axis.last - start).days + 1
    if days > left:
        raise ValueError(f"only {left} of {days} days are left from {start} on")
    return panel.where(F.col("day").between(F.lit(start), F.lit(start + timedelta(days=days - 1))))


def profiles(panel: DataFrame, days: Column | int) -> DataFrame:
    """Mean, population std, zero-day share, variability and daily rate per item, over ALL axis days.

    One aggregation of the sparse rows: days without a row are zeros, so their part of the squared
    deviation is ``(days - rows) * mean^2``.  ``days`` is a number or a scalar-subquery column.
    """
    return _shaped(panel.groupBy("sku_id").agg(*_sums(F.lit(True))), days)


def profiled_series(panel: DataFrame, axis: Axis, days: int) -> DataFrame:
    """``profiles`` over the first ``days`` days of the axis, with ``idx, qty`` of ``series`` over all: one aggregation.
    Items without a row in the first days have no mean; rows of no item are left out."""
    first = F.coalesce(F.col("day") < F.date_add(F.lit(axis.first), days), F.lit(False))
    sums = panel.where(F.col("sku_id").isNotNull()).groupBy("sku_id").agg(*_sums(first), _points(axis).alias("_p"))
    return _shaped(sums, days, F.col("_p.i").alias("idx"), F.col("_p.q").alias("qty"))


def _sums(counted: Column) -> list[Column]:
    qty = F.when(counted, F.col("qty"))
    return [
        F.sum(qty).alias("total"),
        F.count_if(counted).alias("_rows"),
        F.avg(qty).alias("_avg"),
        F.var_pop(qty).alias("_var"),
        F.count_if(qty > 0).alias("_sold"),
    ]


def _shaped(sums: DataFrame, days: Column | int, *more: Column) -> DataFrame:
    n = (days if isinstance(days, Column) else F.lit(days)).cast("double")
    sums = sums.withColumn("n_days", n)
    mean = F.col("total") / F.col("n_days")
    off = F.col("_avg") - mean
    squares = F.col("_rows") * (F.col("_var") + off * off) + (F.col("n_days") - F.col("_rows")) * mean * mean
    shaped = sums.select(
        "sku_id", "total", "n_days",
        mean.alias("mean"),
        F.sqrt(squares / F.col("n_days")).alias("std"),
        (F.lit(1.0) - F.col("_sold") / F.col("n_days")).alias("zero_ratio"), *more,
    )
    later = shaped.columns[6:]
    return shaped.select(
        *shaped.columns[:6],
        (F.col("zero_ratio") > INTERMITTENT_SHARE).alias("intermittent"),
        variability(F.col("mean"), F.col("std"), F.col("zero_ratio")).alias("variability"),
        (F.col("total") / F.greatest(F.lit(1.0), F.col("n_days"))).alias("daily_rate"), *later,
    )


def variability(mean: Column, std: Column, zero_ratio: Column) -> Column:
    """Spread to size safety stock with: for intermittent items at least the average selling-day quantity."""
    smooth = (zero_ratio <= INTERMITTENT_SHARE) | (zero_ratio >= 1.0)
    return F.when(smooth, std).otherwise(F.greatest(std, F.try_divide(mean, F.lit(1.0) - zero_ratio)))


def order_profiles(orders: DataFrame, include_cancelled: bool = False) -> DataFrame:
    """``profiles`` straight from order lines, the axis length as a scalar subquery (fully lazy)."""
    days = axis_row(orders, include_cancelled).select("n").scalar()
    return profiles(item_day_demand(orders, include_cancelled), days)


def dense(panel: DataFrame, axis: Axis, value: str = "qty") -> DataFrame:
    """``(sku_id, day, i, qty)`` for every item and axis day, 0 where nothing sold; ``i`` counts days from 0.

    Gaps are filled from each sparse row to the next, so the only shuffle is of the sparse rows by item and
    the dense rows stay partitioned by item for the windows that follow.  An item has at most one row per
    axis day, so no group grows with the number of order lines.
    """
    by_item = Window.partitionBy("sku_id").orderBy("day")
    start = F.when(F.row_number().over(by_item) == 1, F.lit(axis.first)).otherwise(F.col("day"))
    end = F.coalesce(F.date_sub(F.lead("day").over(by_item), 1), F.lit(axis.last))
    spans = panel.select("sku_id", F.col("day").alias("_at"), F.col(value).alias("_q"), start.alias("_s"), end.alias("_e"))
    filled = spans.select("sku_id", "_at", "_q", F.explode(F.sequence("_s", "_e")).alias("day"))
    return filled.select(
        "sku_id",
        "day",
        F.datediff("day", F.lit(axis.first)).cast("bigint").alias("i"),
        F.when(F.col("day") == F.col("_at"), F.col("_q")).otherwise(F.lit(0.0)).alias("qty"),
    )


def series(panel: DataFrame, axis: Axis) -> DataFrame:
    """``(sku_id, idx, qty)``: one row per item with its selling days (offsets from the first day) in order.

    Arrays hold at most one entry per axis day, whatever the number of order lines.
    """
    packed = panel.groupBy("sku_id").agg(_points(axis).alias("_p"))
    return packed.select("sku_id", F.col("_p.i").alias("idx"), F.col("_p.q").alias("qty"))


def _points(axis: Axis) -> Column:
    return F.sort_array(F.collect_list(F.struct(F.datediff("day", F.lit(axis.first)).alias("i"), F.col("qty").alias("q"))))


def hourly_grid(orders: DataFrame, low: int = 8, high: int = 19) -> DataFrame:
    """``(day, hour, qty)``: business hours ``low .. high-1`` of the days that have orders, 0 where none."""
    hours = kept(orders).groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        F.sum(F.col("quantity").cast("double")).alias("qty")
    )
    # one map per day (at most 24 entries), read hour by hour: no join back
    by_day = hours.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("hour", "qty"))).alias("_m"))
    return by_day.select("day", "_m", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("hour")).select(
        "day", "hour", F.coalesce(F.element_at("_m", F.col("hour")), F.lit(0.0)).alias("qty")
    )


def build_series(orders: DataFrame, min_days: int = 14) -> tuple[DataFrame, str, int]:
    """``(key, i, value)`` of total demand: daily (period 7) with enough order days, else hourly (period 11).

    ``key`` is a constant, so that the per-series operators apply; positions come from the calendar (daily)
    or from the rank of the order day (hourly): an axis of days, never of order lines.
    """
    panel = item_day_demand(orders)
    count = kept(orders).agg(F.count_distinct(F.to_date("ts")).alias("n")).first().n
    if count >= min_days:
        axis = axis_of_panel(panel)
        whole = total_by_day(panel).select(F.lit("all").alias("sku_id"), "day", F.col("total").alias("qty"))
        return dense(whole, axis).select(F.col("sku_id").alias("key"), "i", F.col("qty").alias("value")), "daily", 7
    grid = hourly_grid(orders)
    place = F.row_number().over(Window.partitionBy("key").orderBy("day", "hour")) - 1
    return (
        grid.withColumn("key", F.lit("all")).select("key", place.cast("bigint").alias("i"), F.col("qty").alias("value")),
        "hourly",
        11,
    )
