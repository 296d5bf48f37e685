"""Live item-day demand, live stock position with a reorder signal, and live latest readings.

In update mode each key's last output equals the batch operator on the same rows, late rows aside: a row older than
the watermark is dropped by Spark and shows in the query's ``numRowsDroppedByWatermark``.  In append mode live demand
gives only the days that the watermark has closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ..operators.demand import kept
from ..operators.kpi import member


def live_demand(orders: DataFrame, lateness: str = "2 days") -> DataFrame:
    """``item_day_demand`` over a stream of order lines: day windows closed by the watermark."""
    timed = kept(orders).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", "1 day"), "sku_id").agg(F.sum(F.col("quantity").cast("double")).alias("qty")).select(
        "sku_id", F.to_date("window.start").alias("day"), "qty")


def late_rows(progress: dict) -> int:
    """Rows a query dropped behind its watermark, from its progress report."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for op in progress.get("stateOperators", []))


class StockPosition(StatefulProcessor):
    """Per item: stock on hand and open orders; serves demand, receives what is due, orders up to S at or below s.

    Rows are daily demand with the item's levels, in day order per batch; state is one number and at most
    ``lead_time`` open orders.
    """

    def __init__(self, lead_time: int = 7) -> None:
        self.lead_time = lead_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", StructType([StructField("stock", DoubleType()), StructField("day", LongType())]))
        self.open = handle.getMapState("open", StructType([StructField("due", LongType())]), StructType([StructField("qty", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("i")
        out = []
        state = self.position.get() if self.position.exists() else None
        stock, last = (state[0], state[1]) if state else (None, -1)
        due = {k[0]: v[0] for k, v in self.open.iterator()}
        for row in days.itertuples():
            if stock is None:
                stock = row.order_up_to
            if row.i <= last:
                continue  # a day already closed
            received = sum(q for d, q in due.items() if d <= row.i)
            for d in [d for d in due if d <= row.i]:
                del due[d]
                self.open.removeKey((d,))
            stock += received
            served = min(stock, row.qty)
            stock -= served
            position = stock + sum(q for d, q in sorted(due.items()))
            ordered = max(0.0, row.order_up_to - position) if position <= row.reorder_point else 0.0
            if ordered > 0:
                due[row.i + self.lead_time] = ordered
                self.open.updateValue((row.i + self.lead_time,), (ordered,))
            last = row.i
            out.append((key[0], row.i, row.qty, row.qty - served, stock, received, ordered))
        if stock is not None:
            self.position.update((float(stock), int(last)))
        yield pd.DataFrame(out, columns=["sku_id", "i", "demand", "unmet", "on_hand", "receipts", "ordered"])

    def close(self) -> None:
        pass


POSITION = "sku_id string, i bigint, demand double, unmet double, on_hand double, receipts double, ordered double"


def live_stock(days: DataFrame, lead_time: int = 7) -> DataFrame:
    """Stock position and reorder signal per item from a stream of ``(sku_id, i, qty, reorder_point, order_up_to)``,
    one row per item and day, days of an item in order.  Needs the RocksDB state store."""
    return days.groupBy("sku_id").transformWithStateInPandas(
        StockPosition(lead_time), outputStructType=POSITION, outputMode="Append", timeMode="None")


class LatestReading(StatefulProcessor):
    """Per location: the latest reading by event time; emitted whenever it changes."""

    STATE = StructType([StructField("ts", TimestampType()), StructField("reading_id", LongType()), StructField("value", DoubleType()),
                        StructField("meta", StringType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.latest.get()) if self.latest.exists() else None
        changed = False
        for pdf in rows:
            top = pdf.sort_values(["ts", "reading_id"]).iloc[-1]
            found = (top["ts"].to_pydatetime(), int(top["reading_id"]), float(top["value"]), top["meta"])
            if best is None or found[:2] > tuple(best[:2]):
                best, changed = found, True
        if changed:
            self.latest.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["location_id", "ts", "reading_id", "value", "meta"])

    def close(self) -> None:
        pass


def live_latest(readings: DataFrame) -> DataFrame:
    """The latest reading per location over a stream; feed it to ``kpi.stocktake`` for live discrepancies."""
    rows = readings.select("location_id", F.col("ts").cast("timestamp").alias("ts"), "reading_id", "value", "meta")
    schema = "location_id string, ts timestamp, reading_id bigint, value double, meta string"
    return rows.groupBy("location_id").transformWithStateInPandas(LatestReading(), outputStructType=schema, outputMode="Update", timeMode="None")


def discrepancies(latest: DataFrame, rel_threshold: float = 0.25, min_abs: float = 15) -> DataFrame:
    """The stocktake flag on every changed reading of ``live_latest``."""
    book, est = F.coalesce(member("book_units"), F.lit(0.0)), F.coalesce(member("est_units"), F.lit(0.0))
    diff = est - book
    return latest.select("location_id", "ts", book.alias("book_units"), est.alias("vision_units"), diff.alias("diff")).where(
        (F.abs(diff) >= min_abs) & (F.abs(diff) / F.greatest(F.lit(1.0), book) >= rel_threshold))
