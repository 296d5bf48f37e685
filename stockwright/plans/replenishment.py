"""Demand panel and replenishment queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import demand as dm
from ..operators import kpi
from ..operators import replenish as rp
from . import canonical as c
from .canonical import Tables, with_sql
from .registry import query, r, rounded

PARTS = c.lines_sql()
SUPPLIERS = c.lines_sql("l_suppkey")


@query("b04_demand_lines", "select count(*) as n_lines, cast(sum(cast(l_quantity as int)) as bigint) as units from lineitem where l_returnflag <> 'R'")
def _(t: Tables):
    return dm.kept(c.lines(t)).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("units"))


@query("b05_history_slices", with_sql(PARTS, c.PANEL_SQL) + """select 'until' as slice, count(*) as n_rows, sum(qty) as units
  from panel where day < date '1998-01-01' union all select 'window', count(*), sum(qty) from panel
  where day between date '1998-01-01' and date '1998-01-28'""")
def _(t: Tables):
    lines = c.lines(t)
    panel, axis = dm.item_day_demand(lines), dm.read_axis(lines)
    start = date(1998, 1, 1)
    parts = [("until", dm.until(panel, start)), ("window", dm.window(panel, axis, start, 28))]
    out = [p.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("qty").alias("units")).select(F.lit(n).alias("slice"), "*") for n, p in parts]
    return out[0].unionByName(out[1])


@query("c07_dense_axis", with_sql(SUPPLIERS, c.PANEL_SQL, c.DENSE_SQL) + "select sku_id, cast(day as varchar) as day, i, qty from dense")
def _(t: Tables):
    lines = c.lines(t, "l_suppkey")
    return rounded(dm.dense(dm.item_day_demand(lines), dm.read_axis(lines)))


@query("d01_item_day_demand", with_sql(PARTS, c.PANEL_SQL) + "select sku_id, cast(day as varchar) as day, qty from panel")
def _(t: Tables):
    return rounded(dm.item_day_demand(c.lines(t)))


@query("d02_total_by_day", with_sql(PARTS, c.PANEL_SQL) + "select cast(day as varchar) as day, sum(qty) as total from panel group by 1")
def _(t: Tables):
    return rounded(dm.total_by_day(dm.item_day_demand(c.lines(t))))


@query("d02_active_days", with_sql(PARTS, c.PANEL_SQL) + "select count(*) as active_days from (select day from panel group by 1 having sum(qty) > 0)")
def _(t: Tables):
    return dm.active_days(dm.item_day_demand(c.lines(t)))


@query("d03_profiles", with_sql(PARTS, c.PANEL_SQL, c.PROFILE_SQL) + """select sku_id, total, round(mean, 6) as mean, round(std, 6) as std,
  round(zero_ratio, 6) as zero_ratio from profile""")
def _(t: Tables):
    return rounded(dm.order_profiles(c.lines(t)).select("sku_id", "total", "mean", "std", "zero_ratio"))


@query("d03_profiles_brand", with_sql(c.BRAND_LINES_SQL, c.PANEL_SQL, c.DENSE_SQL) + """select sku_id, round(avg(qty), 6) as mean,
  round(stddev_pop(qty), 6) as std, round(avg(case when qty <= 0 then 1 else 0 end), 6) as zero_ratio from dense group by 1""")
def _(t: Tables):
    return rounded(dm.order_profiles(c.brand_lines(t)).select("sku_id", "mean", "std", "zero_ratio"))


@query("d04_variability", with_sql(PARTS, c.PANEL_SQL, c.PROFILE_SQL) + """select sku_id, zero_ratio > 0.5 as intermittent,
  round(variability, 6) as variability from variability""")
def _(t: Tables):
    return rounded(dm.order_profiles(c.lines(t)).select("sku_id", "intermittent", "variability"))


@query("d05_daily_rates", with_sql(PARTS, c.PANEL_SQL) + """select sku_id, round(sum(qty) / greatest(1, (select n from axis)), 6) as daily_rate
  from panel group by 1""")
def _(t: Tables):
    return rounded(dm.order_profiles(c.lines(t)).select("sku_id", "daily_rate"))


LEVELS = f"""levels as (select *, 1.645 * variability * sqrt(14) as safety_stock, mean * 14 + 1.645 * variability * sqrt(14) as s from variability)"""
AVAILABLE = "available as (select sku_id, sum(greatest(0, on_hand - reserved)) as available from inventory group by 1)"
PLAN = """plan as (select l.*, coalesce(a.available, 0) as available, case when coalesce(a.available, 0) <= s
  then greatest(0, cast(round_even(s - coalesce(a.available, 0), 0) as bigint)) else 0 end as order_qty
  from levels l left join available a on a.sku_id = l.sku_id where mean > 0)"""
PLAN_SQL = with_sql(PARTS, c.PANEL_SQL, c.PROFILE_SQL, c.INVENTORY_SQL, c.SKU_SQL, LEVELS, AVAILABLE, PLAN)


def _plan(t: Tables):
    levels = rp.service_levels(dm.order_profiles(c.lines(t)), 0.95)
    return rp.plan(levels, c.inventory(t))


@query("j01_service_levels", with_sql(PARTS, c.PANEL_SQL, c.PROFILE_SQL, LEVELS) + """select sku_id, round(safety_stock, 6) as safety_stock,
  round(s, 6) as reorder_point, round(s, 6) as order_up_to from levels""")
def _(t: Tables):
    return rounded(rp.service_levels(dm.order_profiles(c.lines(t)), 0.95).select("sku_id", "safety_stock", "reorder_point", "order_up_to"))


@query("j02_naive_levels", with_sql(PARTS, c.PANEL_SQL, c.PROFILE_SQL) + """select sku_id, round(mean * 7, 6) as reorder_point,
  round(mean * 14, 6) as order_up_to from profile""")
def _(t: Tables):
    return rounded(rp.naive_levels(dm.order_profiles(c.lines(t))).select("sku_id", "reorder_point", "order_up_to"))


@query("c04_available_by_item", with_sql(PARTS, c.PANEL_SQL, c.INVENTORY_SQL, AVAILABLE) + """select p.sku_id, cast(coalesce(any_value(a.available), 0) as bigint)
  as available from panel p left join available a on a.sku_id = p.sku_id group by 1""")
def _(t: Tables):
    items = dm.item_day_demand(c.lines(t)).select("sku_id").distinct()
    return items.join(rp.available_by_item(c.inventory(t)), "sku_id", "left").select(
        "sku_id", F.coalesce("available", F.lit(0)).cast("bigint").alias("available"))


@query("j04_plan", PLAN_SQL + """select sku_id, round(s, 6) as reorder_point, cast(available as bigint) as available, cast(order_qty as bigint) as order_qty from plan""")
def _(t: Tables):
    return rounded(_plan(t).select("sku_id", "reorder_point", "available", "order_qty"))


@query("f02_top_orders", PLAN_SQL + """select p.sku_id, k.name, round(mean, 6) as mean, cast(available as bigint) as available,
  cast(order_qty as bigint) as order_qty from plan p left join sku k on k.sku_id = p.sku_id order by order_qty desc, p.sku_id limit 12""")
def _(t: Tables):
    return rounded(rp.top_orders(_plan(t), c.sku(t)).select("sku_id", "name", "mean", "available", "order_qty"))


@query("d31_plan_summary", PLAN_SQL + """select count(*) filter (order_qty > 0) as skus_needing_order, round(sum(safety_stock), 3) as safety_stock_units,
  count(*) filter (order_qty > 0 and zero_ratio > 0.5) as intermittent_needing_order from plan""")
def _(t: Tables):
    return rounded(rp.plan_summary(_plan(t)), 3)


@query("d32_active_stockouts", with_sql(c.INVENTORY_SQL) + "select count(*) filter (greatest(0, on_hand - reserved) = 0) as active_stockouts from inventory")
def _(t: Tables):
    return rp.active_stockouts(c.inventory(t))


@query("b09_plan_dataset", PLAN_SQL + """select p.sku_id, k.category, k.abc_class, case when zero_ratio > 0.5 then 'intermittent' else 'smooth' end as demand_shape,
  case when order_qty > 0 then 'yes' else 'no' end as needs_order, round(mean, 6) as mean_daily_demand, round(safety_stock, 6) as safety_stock,
  round(s, 6) as reorder_point, round(s, 6) as order_up_to, cast(available as bigint) as available, cast(order_qty as bigint) as order_qty
  from plan p left join sku k on k.sku_id = p.sku_id""")
def _(t: Tables):
    return rounded(kpi.plan_dataset(_plan(t), c.sku(t)))



# The replay as a recursion over days: d1 is due tomorrow ... d7 in seven days.
REPLAY_SQL = """dense_levels as materialized (select d.sku_id, d.i, d.qty, l.policy, l.s, l.u from dense d join levels l on l.sku_id = d.sku_id),
sim as (select * from (with recursive walk as (
  select sku_id, policy, s, u, cast(-1 as bigint) as i, u as stock, 0::double as d1, 0::double as d2, 0::double as d3, 0::double as d4, 0::double as d5, 0::double as d6, 0::double as d7,
    0::double as unmet, 0::double as holding, 0::bigint as orders, 0::double as wanted from levels
  union all
  select sku_id, policy, s, u, i, stock, d2, d3, d4, d5, d6, d7, case when pos <= s and u - pos > 0 then u - pos else 0 end, unmet, holding, orders + case when pos <= s and u - pos > 0 then 1 else 0 end, wanted from (
    select *, stock + d2 + d3 + d4 + d5 + d6 + d7 as pos from (
      select w.sku_id, w.policy, w.s, w.u, d.i, w.stock + w.d1 - least(w.stock + w.d1, d.qty) as stock, d2, d3, d4, d5, d6, d7,
        unmet + greatest(0, d.qty - least(w.stock + w.d1, d.qty)) as unmet, holding + w.stock + w.d1 - least(w.stock + w.d1, d.qty) as holding, orders, wanted + d.qty as wanted
      from walk w join dense_levels d on d.sku_id = w.sku_id and d.policy = w.policy and d.i = w.i + 1)))
  select * from walk where i = (select max(n) - 1 from axis)))"""
BOTH_LEVELS = """levels as (select sku_id, 'naive' as policy, mean * 7 as s, mean * 14 as u from profile where mean > 0
  union all select sku_id, 'service-level', mean * 14 + 1.645 * variability * sqrt(14), mean * 14 + 1.645 * variability * sqrt(14) from variability where mean > 0)"""
COST_SQL = """costs as (select policy, sum(unmet) as unmet_units, sum(wanted) as wanted, sum(holding * coalesce(unit_cost, 1) * 0.25 / 313) as holding_cost, sum(orders * 25.0) as order_cost,
  sum(unmet * (coalesce(unit_price, 1.3) - coalesce(unit_cost, 1))) as lost_margin from sim left join sku k on k.sku_id = sim.sku_id group by 1)"""
BRANDS = [c.BRAND_LINES_SQL, c.PANEL_SQL, c.DENSE_SQL, c.PROFILE_SQL, BOTH_LEVELS, REPLAY_SQL]


def _brand_items(t: Tables, policies=("naive", "service-level")):
    lines = c.brand_lines(t)
    axis = dm.read_axis(lines)
    return rp.policy_items(lines, axis, None, list(policies), rp.Costs()), axis


@query("j05_replay_brand", with_sql(*BRANDS) + "select sku_id, policy, round(unmet, 3) as unmet_units, round(holding, 3) as holding_unit_days, orders as n_orders, wanted as total_demand from sim")
def _(t: Tables):
    items, axis = _brand_items(t)
    return rounded(rp.replay(items, axis.days), 3)


@query("j07_simulated_cost_brand", with_sql(*BRANDS, "sku as (select null::varchar as sku_id, 0.0 as unit_cost, 0.0 as unit_price)", COST_SQL) + """select policy, round(unmet_units, 2) as unmet_units, round(1 - unmet_units / wanted, 4) as fill_rate, round(holding_cost, 2) as holding_cost,
  round(order_cost, 2) as order_cost, round(lost_margin, 2) as lost_margin from costs""")
def _(t: Tables):
    found = rp.simulated_cost(c.brand_lines(t), None)
    return rounded(found.withColumn("fill_rate", F.round("fill_rate", 4)), 4).select("policy", *[r(x, 2).alias(x) for x in ("unmet_units", "holding_cost", "order_cost", "lost_margin")], "fill_rate")


@query("j09_financial_impact_brand", with_sql(*BRANDS, "sku as (select null::varchar as sku_id, 0.0 as unit_cost, 0.0 as unit_price)", COST_SQL) + """select round(a.unmet_units - b.unmet_units, 2) as stockout_units_avoided, round(a.lost_margin - b.lost_margin, 2) as stockout_cost_saved,
  round(b.holding_cost - a.holding_cost, 2) as extra_holding_cost, round(b.order_cost - a.order_cost, 2) as extra_order_cost,
  round(a.lost_margin - b.lost_margin - (b.holding_cost - a.holding_cost) - (b.order_cost - a.order_cost), 2) as net_saving,
  round((a.lost_margin - b.lost_margin - (b.holding_cost - a.holding_cost) - (b.order_cost - a.order_cost)) * 313 / (select n from axis), 2) as annualised_net_saving
  from costs a join costs b on a.policy = 'naive' and b.policy = 'service-level'""")
def _(t: Tables):
    return rounded(rp.financial_impact(c.brand_lines(t), None), 2)


def _supplier_items(t: Tables):
    lines = c.lines(t, "l_suppkey")
    axis = dm.read_axis(lines)
    return rp.policy_items(lines, axis, None, ["naive", "service-level"], rp.Costs()), axis


@query("j05_replay")
def _(t: Tables):
    items, axis = _supplier_items(t)
    return rounded(rp.replay(items, axis.days))


@query("j05_replay_expression")
def _(t: Tables):
    lines = c.brand_lines(t)
    axis = dm.read_axis(lines)
    items = rp.policy_items(lines, axis, None, ["service-level"], rp.Costs())
    return rounded(rp.replay_by_expression(items, axis.days))


@query("j03_cost_based_levels")
def _(t: Tables):
    lines = c.lines(t, "l_suppkey")
    axis = dm.read_axis(lines)
    items = rp.policy_items(lines, axis, None, ["cost-based"], rp.Costs())
    return rounded(items.select("sku_id", "safety_stock", "reorder_point", "order_up_to"))


@query("j06_candidate_replay")
def _(t: Tables):
    lines = c.lines(t, "l_suppkey")
    axis = dm.read_axis(lines)
    base = rp.with_prices(
        dm.profiles(dm.item_day_demand(lines), axis.days).join(dm.series(dm.item_day_demand(lines), axis), "sku_id"), None)
    return rounded(rp.cost_based_levels(base, axis.days).select("sku_id", "reorder_point", "order_up_to", "least_cost"))


@query("j07_simulated_cost")
def _(t: Tables):
    return rounded(rp.simulated_cost(c.lines(t), c.sku(t)), 2)


@query("j07_simulated_cost_holdout")
def _(t: Tables):
    return rounded(rp.simulated_cost(c.lines(t), c.sku(t), holdout_days=30), 2)


@query("j08_policy_comparison")
def _(t: Tables):
    return rounded(rp.policy_comparison(c.lines(t, "l_suppkey"), None), 2)


@query("j09_financial_impact")
def _(t: Tables):
    return rounded(rp.financial_impact(c.lines(t), c.sku(t)), 2)


@query("j11_signal_panel")
def _(t: Tables):
    lines = c.lines(t, "l_suppkey")
    axis = dm.read_axis(lines)
    items = rp.policy_items(lines, axis, None, ["service-level"], rp.Costs())
    return rounded(rp.daily_replay(items, axis))
