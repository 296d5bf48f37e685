"""Streams over small files give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockwright.operators import demand as dm, kpi, replenish as rp
from stockwright.streaming import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(query_df, name, mode, tmp_path):
    writer = query_df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name))
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return q


def test_live_demand_equals_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1) + timedelta(hours=5 * i), f"s{i % 3}", i % 4 + 1, "cancelled" if i % 7 == 0 else "shipped") for i in range(60)]
    schema = "ts timestamp, sku_id string, quantity int, status string"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):  # files in time order
        df.orderBy("ts").where((F.unix_timestamp("ts") >= 1704067200 + k * 20 * 18000) & (F.unix_timestamp("ts") < 1704067200 + (k + 1) * 20 * 18000)).coalesce(1).write.mode("append").parquet(str(tmp_path / "orders"))
    # one more line far in the future closes every earlier window
    spark.createDataFrame([(datetime(2024, 3, 1), "s0", 1, "shipped")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "orders"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "orders"))
    q = run(live.live_demand(stream), "live_demand", "append", tmp_path)
    got = {(r.sku_id, r.day, r.qty) for r in spark.table("live_demand").collect()}
    want = {(r.sku_id, r.day, r.qty) for r in dm.item_day_demand(df).collect()}
    assert got == want and live.late_rows(q.lastProgress) == 0


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_live_stock_equals_the_replay(spark, tmp_path, rocks):
    demand = [6.0, 6.0, 1.0, 1.0, 4.0, 0.0]
    schema = "sku_id string, i bigint, qty double, reorder_point double, order_up_to double"
    for k in range(2):
        spark.createDataFrame([("a", i, demand[i], 4.0, 10.0) for i in range(3 * k, 3 * k + 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "days"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "days"))
    run(live.live_stock(stream, 2), "live_stock", "append", tmp_path)
    rows = spark.table("live_stock").orderBy("i").collect()
    assert [r.on_hand for r in rows] == [4, 0, 5, 4, 0, 6] and [r.ordered for r in rows] == [6, 0, 0, 6, 0, 0] and sum(r.unmet for r in rows) == 2


def test_live_latest_equals_batch(spark, tmp_path, rocks):
    schema = "location_id string, ts timestamp, reading_id bigint, value double, meta string"
    rows = [(f"l{i % 4}", datetime(2024, 1, 1) + timedelta(minutes=(i * 37) % 50), i, float(i), f'{{"book_units": 10, "est_units": {i * 3}}}') for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "readings"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "readings"))
    run(live.live_latest(stream), "live_latest", "update", tmp_path)
    last = kpi.latest_reading(spark.table("live_latest"))
    want = kpi.latest_reading(spark.createDataFrame(rows, schema))
    assert {(r.location_id, r.reading_id) for r in last.collect()} == {(r.location_id, r.reading_id) for r in want.collect()}
    assert live.discrepancies(last).count() == kpi.stocktake(want).where("flagged").count()
