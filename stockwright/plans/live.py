"""Streaming queries: a stream over the given tables runs to its end and must equal the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import demand as dm
from ..operators import kpi
from ..operators import replenish as rp
from ..session import shared_folder
from ..streaming import live
from . import canonical as c
from .canonical import Tables, with_sql
from .portfolio import CHECKED_SQL, LATEST_SQL
from .registry import query, rounded
from .replenishment import BRANDS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(t: Tables, stream: DataFrame, mode: str, name: str, rocks: bool = False) -> DataFrame:
    """Run a stream over what is there into a written table, and read it."""
    before = t.spark.conf.get(STATE_STORE)
    path = shared_folder(t.spark, name)
    if rocks:
        t.spark.conf.set(STATE_STORE, ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
        # a folder per batch, overwritten: a batch that is run again leaves its rows once
        q = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).start()
        q.awaitTermination()
    finally:
        t.spark.conf.set(STATE_STORE, before)
    return t.spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)


def _stream(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(t(name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


class _Streams:
    """The table reader of the entity views, reading streams."""

    def __init__(self, t: Tables) -> None:
        self.spark, self._t = t.spark, t

    def __call__(self, name: str) -> DataFrame:
        return _stream(self._t, name)


@query("n01_live_demand", with_sql(c.lines_sql("l_suppkey"), c.PANEL_SQL) + """select sku_id, cast(day as varchar) as day, qty from panel""")
def _(t: Tables):
    # update mode also gives the days that are still open when the stream ends; a day's last update holds
    found = _run(t, live.live_demand(c.lines(_Streams(t), "l_suppkey")), "update", "live-demand")
    return rounded(found.groupBy("sku_id", "day").agg(F.max_by("qty", "batch").alias("qty")))


@query("n02_live_stock", with_sql(*BRANDS) + "select sku_id, round(unmet, 3) as unmet, orders as n_orders, wanted as demand from sim where policy = 'service-level'")
def _(t: Tables):
    lines = c.brand_lines(t)
    axis = dm.read_axis(lines)
    panel = dm.item_day_demand(lines)
    levels = rp.service_levels(dm.profiles(panel, axis.days)).select("sku_id", "reorder_point", "order_up_to")
    path = shared_folder(t.spark, "stock-days")
    dm.dense(panel, axis).join(levels, "sku_id").select("sku_id", "i", "qty", "reorder_point", "order_up_to").write.parquet(path)
    days = t.spark.readStream.schema("sku_id string, i bigint, qty double, reorder_point double, order_up_to double").parquet(path)
    found = _run(t, live.live_stock(days), "append", "live-stock", rocks=True)
    return rounded(found.groupBy("sku_id").agg(F.sum("unmet").alias("unmet"), F.count_if(F.col("ordered") > 0).alias("n_orders"), F.sum("demand").alias("demand")), 3)


@query("n03_live_discrepancies", with_sql(c.SENSOR_SQL, LATEST_SQL, CHECKED_SQL) + "select location_id, book_units, vision_units, diff from checked where flagged")
def _(t: Tables):
    latest = _run(t, live.live_latest(c.sensor(_Streams(t))), "update", "live-latest", rocks=True)
    found = live.discrepancies(kpi.latest_reading(latest))
    return found.select("location_id", "book_units", "vision_units", "diff")
