"""The benchmark tables seen as warehouse entities: one view per entity, as DataFrames and as SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import prepare


@dataclass(frozen=True)
class Tables:
    """Lazy reader of a folder of Parquet tables."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(prepare(spark), folder)


def brand_number(brand: Column) -> Column:
    return F.substring(brand, 7, 10).cast("int")


def sku(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t("part").select(
        F.col("p_partkey").cast("string").alias("sku_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        (F.col("p_retailprice") * F.lit(0.6)).alias("unit_cost"),
        F.col("p_retailprice").alias("unit_price"),
        F.when(size <= 10, "A").when(size <= 25, "B").otherwise("C").alias("abc_class"),
        F.lit(None).cast("int").alias("shelf_life_days"),
        F.lit(0.1).alias("weight_kg"),
        F.lit(0.001).alias("volume_m3"),
    )


def location(t: Tables) -> DataFrame:
    number = brand_number(F.col("p_brand"))
    zone = (
        F.when(number % 5 == 0, "INBOUND").when(number % 5 == 1, "BULK").when(number % 5 == 2, "PICK")
        .when(number % 5 == 3, "COLD").otherwise("OUTBOUND")
    )
    return t("part").select(F.col("p_brand")).distinct().select(
        F.col("p_brand").alias("location_id"),
        zone.alias("zone"),
        F.concat(F.lit("A"), (number % 3).cast("string")).alias("aisle"),
        number.alias("level"),
        F.lit(500).alias("capacity_units"),
    )


def inventory(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t("part").select(
        key.cast("string").alias("sku_id"),
        F.col("p_brand").alias("location_id"),
        ((key * 37) % 500).cast("int").alias("on_hand"),
        ((key * 11) % 120).cast("int").alias("reserved"),
        ((key % 4) * 25).cast("int").alias("in_transit"),
    )


def _status() -> Column:
    return F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("shipped").alias("status")


def lines(t: Tables, item: str = "l_partkey") -> DataFrame:
    """Outbound lines by part or supplier, without the order attributes (one scan, no join)."""
    return t("lineitem").select(
        F.col("l_shipdate").alias("ts"),
        F.col(item).cast("string").alias("sku_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _status(),
    )


def brand_lines(t: Tables) -> DataFrame:
    """Outbound lines by brand."""
    return (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_shipdate").alias("ts"), F.col("p_brand").alias("sku_id"),
                F.col("l_quantity").cast("int").alias("quantity"), _status())
    )


def outbound(t: Tables) -> DataFrame:
    """Outbound lines by part with channel and priority."""
    segment, urgency = F.col("c_mktsegment"), F.col("o_orderpriority")
    orders = (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            "o_orderkey",
            F.when(segment == "BUILDING", "store").when(segment == "MACHINERY", "wholesale").otherwise("ecommerce").alias("channel"),
            F.when(urgency.isin("1-URGENT", "2-HIGH"), "express").otherwise("standard").alias("priority"),
        )
    )
    return t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("l_shipdate").alias("ts"),
        F.col("l_partkey").cast("string").alias("sku_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.coalesce("channel", F.lit("ecommerce")).alias("channel"),
        F.coalesce("priority", F.lit("standard")).alias("priority"),
        _status(),
    )


def sensor(t: Tables) -> DataFrame:
    """Readings; each estimates ``est_units`` and books ``book_units`` in a JSON member."""
    return t("events").select(
        F.col("event_id").alias("reading_id"),
        F.col("ts"),
        (F.col("user_id") % 40).cast("string").alias("location_id"),
        F.col("event_type").alias("modality"),
        F.col("value"),
        F.concat(
            F.lit('{"est_units": '), F.get_json_object("props", "$.k"),
            F.lit(', "book_units": '), F.col("user_id").cast("string"), F.lit("}"),
        ).alias("meta"),
    )


# The same views as SQL text for the checking engine.
SKU_SQL = """sku as (select cast(p_partkey as varchar) as sku_id, p_name as name, p_type as category,
  p_retailprice * cast(0.6 as double) as unit_cost, p_retailprice as unit_price,
  case when p_size <= 10 then 'A' when p_size <= 25 then 'B' else 'C' end as abc_class from part)"""
LOCATION_SQL = """location as (select distinct p_brand as location_id,
  case cast(substr(p_brand, 7) as int) % 5 when 0 then 'INBOUND' when 1 then 'BULK' when 2 then 'PICK' when 3 then 'COLD'
  else 'OUTBOUND' end as zone, 'A' || cast(cast(substr(p_brand, 7) as int) % 3 as varchar) as aisle,
  cast(substr(p_brand, 7) as int) as level from part)"""
INVENTORY_SQL = """inventory as (select cast(p_partkey as varchar) as sku_id, p_brand as location_id,
  cast((p_partkey * 37) % 500 as int) as on_hand, cast((p_partkey * 11) % 120 as int) as reserved,
  cast((p_partkey % 4) * 25 as int) as in_transit from part)"""


def lines_sql(item: str = "l_partkey") -> str:
    return f"""lines as (select l_shipdate as ts, cast({item} as varchar) as sku_id, cast(l_quantity as int) as quantity,
  case when l_returnflag = 'R' then 'cancelled' else 'shipped' end as status from lineitem)"""


BRAND_LINES_SQL = """lines as (select l_shipdate as ts, p_brand as sku_id, cast(l_quantity as int) as quantity,
  case when l_returnflag = 'R' then 'cancelled' else 'shipped' end as status
  from lineitem join part on l_partkey = p_partkey)"""
OUTBOUND_SQL = """outbound as (select l_shipdate as ts, cast(l_partkey as varchar) as sku_id, cast(l_quantity as int) as quantity,
  case c_mktsegment when 'BUILDING' then 'store' when 'MACHINERY' then 'wholesale' else 'ecommerce' end as channel,
  case when o_orderpriority in ('1-URGENT','2-HIGH') then 'express' else 'standard' end as priority,
  case when l_returnflag = 'R' then 'cancelled' else 'shipped' end as status
  from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey)"""
SENSOR_SQL = """sensor as (select event_id as reading_id, ts, cast(user_id % 40 as varchar) as location_id,
  event_type as modality, value, cast(json_extract_string(props, '$.k') as double) as est_units,
  cast(user_id as double) as book_units from events)"""
PANEL_SQL = """panel as (select sku_id, cast(ts as date) as day, cast(sum(quantity) as double) as qty from lines
  where status <> 'cancelled' group by 1, 2),
axis as (select min(day) as first_day, max(day) as last_day, cast(max(day) - min(day) as bigint) + 1 as n from panel)"""
PROFILE_SQL = """sums as (select sku_id, sum(qty) as total, count(*) as sold from panel group by 1),
profile as (select p.sku_id, s.total, s.total / n as mean,
  sqrt((sum((qty - s.total / n) * (qty - s.total / n)) + (n - s.sold) * (s.total / n) * (s.total / n)) / n) as std,
  1.0::double - s.sold / n::double as zero_ratio, n
  from panel p join sums s on p.sku_id = s.sku_id cross join axis group by p.sku_id, s.total, s.sold, n),
variability as (select *, case when zero_ratio <= 0.5 or zero_ratio >= 1 then std
  else greatest(std, mean / (1 - zero_ratio)) end as variability from profile)"""
DENSE_SQL = """dense as (select i.sku_id, d.day, cast(d.day - a.first_day as bigint) as i, coalesce(p.qty, 0) as qty
  from (select distinct sku_id from panel) i cross join axis a
  cross join (select cast(unnest(generate_series(first_day, last_day, interval 1 day)) as date) as day from axis) d
  left join panel p on p.sku_id = i.sku_id and p.day = d.day)"""


def with_sql(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


Query = Callable[[SparkSession, str], DataFrame]
