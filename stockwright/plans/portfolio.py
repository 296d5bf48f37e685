"""KPI, dataset, stock and stocktake queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions.times import time_key, weekday
from ..operators import demand as dm
from ..operators import kpi
from . import canonical as c
from .canonical import Tables, with_sql
from .registry import query, r, rounded

PARTS = c.lines_sql()
LINE_SQL = """order_lines as (select cast(cast(o.ts as date) as varchar) as date, o.sku_id, category, abc_class, channel, priority, status,
  cast(quantity as bigint) as quantity, round(quantity * unit_price, 2) as line_value from outbound o left join sku k on k.sku_id = o.sku_id)"""
RATES_SQL = "rates as (select sku_id, sum(qty) / (select n from axis) as daily_rate from panel group by 1)"


@query("b06_order_lines", with_sql(c.OUTBOUND_SQL, c.SKU_SQL, LINE_SQL) + "select * from order_lines")
def _(t: Tables):
    return rounded(kpi.order_lines(c.outbound(t), c.sku(t)), 2)


@query("c01_lines_with_sku", with_sql(c.OUTBOUND_SQL, c.SKU_SQL) + """select abc_class, count(*) as n_lines, cast(sum(quantity) as bigint) as units
  from outbound o left join sku k on k.sku_id = o.sku_id group by 1""")
def _(t: Tables):
    return kpi.order_lines(c.outbound(t), c.sku(t)).groupBy("abc_class").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("units"))


INVENTORY_LINES = """select i.sku_id, category, abc_class, i.location_id, zone, cast(on_hand as bigint) as on_hand, cast(reserved as bigint) as reserved,
  cast(greatest(0, on_hand - reserved) as bigint) as available, cast(in_transit as bigint) as in_transit, round(on_hand * unit_cost, 2) as stock_value
  from inventory i left join sku k on k.sku_id = i.sku_id left join location l on l.location_id = i.location_id"""


@query("b07_inventory_lines", with_sql(c.INVENTORY_SQL, c.SKU_SQL, c.LOCATION_SQL) + INVENTORY_LINES)
def _(t: Tables):
    return rounded(kpi.inventory_lines(c.inventory(t), c.sku(t), c.location(t)), 2)


@query("c02_stock_by_zone", with_sql(c.INVENTORY_SQL, c.SKU_SQL, c.LOCATION_SQL) + f"""select zone, abc_class, count(*) as positions,
  cast(sum(available) as bigint) as available from ({INVENTORY_LINES}) group by 1, 2""")
def _(t: Tables):
    return kpi.inventory_lines(c.inventory(t), c.sku(t), c.location(t)).groupBy("zone", "abc_class").agg(
        F.count(F.lit(1)).alias("positions"), F.sum("available").alias("available"))


@query("b08_sku_catalogue", with_sql(c.SKU_SQL) + """select sku_id, name, category, abc_class, round(unit_cost, 6) as unit_cost,
  round(unit_price, 6) as unit_price, cast(null as bigint) as shelf_life_days from sku""")
def _(t: Tables):
    return rounded(kpi.sku_catalogue(c.sku(t)))


@query("c03_stock_value", with_sql(c.INVENTORY_SQL, c.SKU_SQL) + """select cast((select sum(on_hand) from inventory) as bigint) as total_on_hand,
  round(sum(on_hand * unit_cost), 2) as inventory_value from inventory i join sku k on k.sku_id = i.sku_id""")
def _(t: Tables):
    return rounded(kpi.stock_value(c.inventory(t), c.sku(t)), 2)


@query("d06_kpis", with_sql(c.INVENTORY_SQL, c.SKU_SQL, c.OUTBOUND_SQL) + """select (select count(distinct sku_id) from sku) as total_skus,
  (select cast(sum(on_hand) as bigint) from inventory) as total_on_hand,
  (select round(sum(on_hand * unit_cost), 2) from inventory i join sku k on k.sku_id = i.sku_id) as inventory_value,
  count(*) as outbound_lines, round(count(*) filter (status = 'cancelled') / greatest(1, count(*)), 4) as cancel_rate,
  round(count(*) filter (priority = 'express') / greatest(1, count(*)), 4) as express_rate from outbound""")
def _(t: Tables):
    return kpi.kpis(c.sku(t), c.inventory(t), c.outbound(t))


@query("d07_abc_distribution", with_sql(c.SKU_SQL) + "select abc_class, count(*) as n from sku group by 1")
def _(t: Tables):
    return kpi.abc_distribution(c.sku(t))


@query("f01_top_movers", with_sql(PARTS, c.PANEL_SQL, c.SKU_SQL, RATES_SQL) + """select r.sku_id, coalesce(k.name, '?') as name,
  coalesce(k.abc_class, '?') as abc_class, round(daily_rate, 2) as avg_daily_demand from rates r left join sku k on k.sku_id = r.sku_id
  order by daily_rate desc, r.sku_id limit 8""")
def _(t: Tables):
    return kpi.top_movers(dm.order_profiles(c.lines(t)), c.sku(t))


@query("k01_stock_rules", with_sql(PARTS, c.PANEL_SQL, c.INVENTORY_SQL, RATES_SQL) + """select * from (select case when greatest(0, on_hand - reserved) = 0 then 'stockout'
  when coalesce(daily_rate, 0) = 0 and on_hand > 100 then 'dead_stock' end as type, i.sku_id, location_id, cast(on_hand as bigint) as on_hand
  from inventory i left join rates r on r.sku_id = i.sku_id) where type is not null""")
def _(t: Tables):
    return rounded(kpi.stock_rules(c.inventory(t), dm.order_profiles(c.lines(t))))


LATEST_SQL = "latest as (select * from sensor qualify row_number() over (partition by location_id order by ts desc, reading_id desc) = 1)"
CHECKED_SQL = """checked as (select location_id, book_units, est_units as vision_units, est_units - book_units as diff,
  abs(est_units - book_units) / greatest(1, book_units) as rel,
  abs(est_units - book_units) >= 15 and abs(est_units - book_units) / greatest(1, book_units) >= 0.25 as flagged,
  case when est_units - book_units < 0 then 'shortage' else 'surplus' end as direction from latest)"""


@query("e09_latest_reading", with_sql(c.SENSOR_SQL, LATEST_SQL) + "select location_id, reading_id, modality, round(value, 6) as value from latest")
def _(t: Tables):
    return rounded(kpi.latest_reading(c.sensor(t)).select("location_id", "reading_id", "modality", "value"))


@query("k05_stocktake", with_sql(c.SENSOR_SQL, LATEST_SQL, CHECKED_SQL) + "select location_id, book_units, vision_units, diff, round(rel, 6) as rel, flagged, direction from checked")
def _(t: Tables):
    return rounded(kpi.stocktake(kpi.latest_reading(c.sensor(t))))


@query("k05_stocktake_summary", with_sql(c.SENSOR_SQL, LATEST_SQL, CHECKED_SQL) + """select count(*) as locations_scanned, count(*) filter (not flagged) as matched,
  count(*) filter (flagged) as flagged, round(count(*) filter (not flagged) / greatest(1, count(*)), 4) as match_rate,
  coalesce(sum(diff) filter (flagged), 0) as net_unit_variance from checked""")
def _(t: Tables):
    return kpi.stocktake_summary(kpi.stocktake(kpi.latest_reading(c.sensor(t))))


@query("f05_top_discrepancies", with_sql(c.SENSOR_SQL, LATEST_SQL, CHECKED_SQL) + """select location_id, book_units, vision_units, diff, round(rel, 6) as rel, flagged, direction
  from checked where flagged order by abs(diff) desc, location_id limit 20""")
def _(t: Tables):
    return rounded(kpi.top_discrepancies(kpi.stocktake(kpi.latest_reading(c.sensor(t)))))


CELLS_SQL = """places as (select location_id, zone, aisle, cast(level as varchar) as shelf from location),
cells as (select zone, aisle, l.location_id, value as occupancy, book_units, est_units from latest l join places p on p.shelf = l.location_id)"""


def _cells(t: Tables):
    shelves = c.location(t).select(F.col("level").cast("string").alias("location_id"), "zone", "aisle")
    return kpi.occupancy(kpi.latest_reading(c.sensor(t)), shelves)


@query("c05_reading_locations", with_sql(c.SENSOR_SQL, LATEST_SQL, c.LOCATION_SQL, CELLS_SQL) + "select zone, aisle, location_id, round(occupancy, 6) as occupancy, book_units, est_units from cells")
def _(t: Tables):
    return rounded(_cells(t))


@query("k06_occupancy_grid", with_sql(c.SENSOR_SQL, LATEST_SQL, c.LOCATION_SQL, CELLS_SQL) + """select zone, aisle, string_agg(location_id, ',' order by location_id) as cells,
  count(*) as n_cells, round(sum(occupancy), 6) as occupancy from cells group by 1, 2""")
def _(t: Tables):
    grid = kpi.occupancy_grid(_cells(t))
    return rounded(grid.select(
        "zone", "aisle", F.array_join("cells.location_id", ",").alias("cells"), F.size("cells").alias("n_cells"),
        F.aggregate("cells.occupancy", F.lit(0.0), lambda a, b: a + b).alias("occupancy")))


QUALITY_SQL = """select (select count(*) from inventory where sku_id not in (select sku_id from sku) or location_id not in (select location_id from location)) = 0 as inventory_references,
  (select count(*) from inventory where on_hand < 0 or reserved < 0) = 0 as inventory_non_negative,
  (select count(*) from lines where sku_id not in (select sku_id from sku)) = 0 as outbound_references,
  (select count(distinct sku_id) from inventory) / greatest(1, (select count(distinct sku_id) from sku)) >= 0.99 as sku_coverage_full,
  (select count(distinct sku_id) from sku) as sku_count,
  round((select count(distinct sku_id) from inventory) / greatest(1, (select count(distinct sku_id) from sku)), 4) as sku_coverage, true as passed"""


@query("b10_structural_quality", with_sql(PARTS, c.INVENTORY_SQL, c.SKU_SQL, c.LOCATION_SQL) + QUALITY_SQL)
def _(t: Tables):
    return kpi.structural_quality(c.sku(t), c.location(t), c.inventory(t), c.lines(t))


@query("c06_reference_checks", with_sql(PARTS, c.SKU_SQL) + """select 'known' as kind, count(*) as n from lines where sku_id in (select sku_id from sku where abc_class = 'A')
  union all select 'unknown', count(*) from lines where sku_id not in (select sku_id from sku where abc_class = 'A')""")
def _(t: Tables):
    lines, keys = c.lines(t), c.sku(t).where(F.col("abc_class") == "A").select("sku_id")
    known = lines.join(keys, "sku_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("known").alias("kind"), "n")
    lost = lines.join(keys, "sku_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown").alias("kind"), "n")
    return known.unionByName(lost)


# --- scalar functions ------------------------------------------------------------------------------


@query("h04_time_keys", """select distinct cast(cast(l_shipdate as date) as varchar) as day, strftime(l_shipdate, '%G-W%V') as week, strftime(l_shipdate, '%Y-%m') as month,
  strftime(l_shipdate, '%Y') || '-Q' || cast(quarter(l_shipdate) as varchar) as quarter, strftime(l_shipdate, '%Y') as year, strftime(l_shipdate, '%a') as weekday from lineitem""")
def _(t: Tables):
    day = t("lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return day.select(*[time_key(F.col("d"), g).alias(g) for g in ["day", "week", "month", "quarter", "year", "weekday"]])


@query("h05_hour_weekday", "select hour(ts) as hour, isodow(ts) - 1 as weekday, count(*) as n from events group by 1, 2")
def _(t: Tables):
    return rounded(t("events").groupBy(F.hour("ts").alias("hour"), weekday(F.col("ts")).alias("weekday")).agg(F.count(F.lit(1)).alias("n")))


@query("h06_available", with_sql(c.INVENTORY_SQL) + "select sku_id, cast(greatest(0, on_hand - reserved) as bigint) as available from inventory")
def _(t: Tables):
    return rounded(c.inventory(t).select("sku_id", kpi.available().alias("available")))


@query("h08_half_even", "select o_orderkey, cast(round_even(o_totalprice / 2, 0) as bigint) as half from orders")
def _(t: Tables):
    return t("orders").select("o_orderkey", nm.half_even(F.col("o_totalprice") / 2).alias("half"))


@query("h09_math", """select o_orderkey, round(ln(o_totalprice), 6) as ln, round(ln(1 + o_totalprice), 6) as ln1p, round(exp(-o_totalprice / 100000), 6) as exp,
  round(sqrt(o_totalprice), 6) as sqrt, least(greatest(o_totalprice, 50000), 200000) as clip from orders""")
def _(t: Tables):
    p = F.col("o_totalprice")
    return rounded(t("orders").select("o_orderkey", F.ln(p).alias("ln"), F.log1p(p).alias("ln1p"), F.exp(-p / 100000).alias("exp"),
                                      F.sqrt(p).alias("sqrt"), nm.clip(p, 50000.0, 200000.0).alias("clip")))


@query("h11_json_member", "select event_id, cast(json_extract_string(props, '$.k') as double) as k from events")
def _(t: Tables):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("h12_readings", """select o_orderkey, case when c_acctbal - 2000 <= 0 and c_acctbal + 1000 >= 0 then 'covers zero' when c_acctbal - 2000 > 0 then 'above zero' else 'below zero' end as reading,
  case when o_totalprice / 500000 < 0.6 then 'hard to distinguish' when o_totalprice / 500000 <= 0.8 then 'distinguishable' else 'easily distinguished' end as verdict
  from orders join customer on o_custkey = c_custkey""")
def _(t: Tables):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", nm.interval_reading(F.col("c_acctbal") - 2000, F.col("c_acctbal") + 1000).alias("reading"),
                         nm.verdict_of_auc(F.col("o_totalprice") / 500000).alias("verdict"))
