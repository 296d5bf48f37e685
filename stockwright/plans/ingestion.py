"""Source, contract and extension-point queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demand as dm
from ..operators import replenish as rp
from ..sources import delimited as de
from ..sources import entities as en
from ..sources import tables as tb
from . import canonical as c
from .canonical import Tables, with_sql
from .registry import query, rounded

SCHEMA = de.Schema((de.ColumnSpec("l_shipdate", "time"), de.ColumnSpec("l_partkey", "id"), de.ColumnSpec("l_quantity", "real"),
                    de.ColumnSpec("l_price", "real")), {"time": "l_shipdate", "item": "l_partkey", "quantity": "l_quantity", "price": "l_price"})


def _source(t: Tables):
    """Line items as a parsed source: returned lines negative, tiny discounts as zero quantity."""
    li = t("lineitem")
    qty = F.when(F.col("l_discount") == 0, F.lit(0.0)).when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity") + 0.5)
    return li.select("l_shipdate", "l_partkey", qty.alias("l_quantity"), F.col("l_extendedprice").alias("l_price"))


SOURCE_SQL = """source as (select l_shipdate as ts, cast(l_partkey as varchar) as sku_id, cast(round_even(case when l_discount = 0 then 0 when l_returnflag = 'R' then -l_quantity else l_quantity + 0.5::double end, 0) as bigint) as q,
  l_extendedprice as price from lineitem), kept as (select * from source where q <> 0)"""


@query("a06_source_orders", with_sql(SOURCE_SQL) + """select cast(cast(ts as date) as varchar) as day, sku_id, abs(q) as quantity, case when q > 0 then 'shipped' else 'cancelled' end as status, count(*) as n from kept group by 1, 2, 3, 4""")
def _(t: Tables):
    orders = en.canonical(_source(t), SCHEMA.roles)[1]
    return orders.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "sku_id", "quantity", "status").agg(F.count(F.lit(1)).alias("n"))


@query("a06_source_skus", with_sql(SOURCE_SQL) + """select sku_id, round(median(price) filter (price > 0), 6) as unit_price from kept group by 1""")
def _(t: Tables):
    return rounded(en.canonical(_source(t), SCHEMA.roles)[0].select("sku_id", "unit_price"))


@query("d30_median_price", """select p_brand, round(median(l_extendedprice / l_quantity), 4) as price, median(l_quantity) as quantity from lineitem join part on l_partkey = p_partkey group by 1""")
def _(t: Tables):
    from ..functions.ranks import exact_medians

    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(exact_medians(joined.select("p_brand", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity")),
                                 ["p_brand"], ["price", "quantity"]), 4)


ORDER_SCHEMA = de.Schema((de.ColumnSpec("o_orderkey", "id"), de.ColumnSpec("o_orderdate", "time"), de.ColumnSpec("o_orderpriority", "category"),
                          de.ColumnSpec("o_totalprice", "real")), {"time": "o_orderdate"})


@query("a07_dataset", "select o_orderkey, cast(cast(o_orderdate as date) as varchar) as o_orderdate, o_orderpriority, o_totalprice from orders")
def _(t: Tables):
    return en.dataset(t("orders").select(*ORDER_SCHEMA.names), ORDER_SCHEMA)


@query("a07_dataset_sample", """select o_orderkey, cast(cast(o_orderdate as date) as varchar) as o_orderdate, o_totalprice from orders order by md5('7|' || cast(o_orderkey as varchar)), o_orderkey limit 500""")
def _(t: Tables):
    return en.dataset(t("orders").select(*ORDER_SCHEMA.names), ORDER_SCHEMA, columns=["o_orderkey", "o_orderdate", "o_totalprice"], limit=500, seed=7, keys=["o_orderkey"])


@query("a09_feature_table", """select value as qty, cast(event_id % 90 + 1 as double) as price, cast(hour(ts) as double) as hour, cast(isodow(ts) - 1 as double) as weekday from events
  where value > 0""")
def _(t: Tables):
    rows = t("events").withColumn("price", F.col("event_id") % 90 + 1)
    return en.feature_table(rows, "ts", "value", "price")


@query("a10_model_table", """with kept as (select o_orderkey, o_totalprice, o_orderpriority, month(o_orderdate) as m from orders),
  codes as (select o_orderpriority as label, row_number() over (order by count(*) desc, o_orderpriority) - 1 as code from kept group by 1)
  select o_totalprice, cast(code as double) as o_orderpriority from kept join codes on label = o_orderpriority""")
def _(t: Tables):
    return en.model_table(t("orders"), ["o_totalprice"], ["o_orderpriority"])[0]


@query("a10_decode", """select o_orderkey, label from (select o_orderkey, least(greatest(floor(o_totalprice / 60000 - 1 + 0.5::double), 0), 4) as k from orders)
  join (select o_orderpriority as label, row_number() over (order by count(*) desc, o_orderpriority) - 1 as code from orders group by 1) on code = k""")
def _(t: Tables):
    codes = {"label": en.category_codes(t("orders"), "o_orderpriority")}
    return en.decode(t("orders").select("o_orderkey", (F.col("o_totalprice") / 60000 - 1).alias("label")), codes)


@query("a11_copula_input", """select o_totalprice, o_custkey from orders where o_totalprice > 0 and o_totalprice < (select quantile_cont(o_totalprice, 0.99) from orders where o_totalprice > 0)""")
def _(t: Tables):
    return en.copula_input(t("orders"), ["o_totalprice", "o_custkey"], "o_totalprice")


@query("a12_csv_cells", """select event_id, case when regexp_matches(x, '^[=+@-]') then '''' || x else x end as cell from (select event_id, case event_id % 4 when 0 then '=' when 1 then '-' when 2 then '@' else '' end || event_type as x from events)""")
def _(t: Tables):
    mark = F.element_at(F.array(*[F.lit(x) for x in ("=", "-", "@", "")]), (F.col("event_id") % 4 + 1).cast("int"))
    return tb.csv_safe(t("events").select("event_id", F.concat(mark, "event_type").alias("cell")))


@query("a12_nested_cells", """select event_id, '{"type":"' || event_type || '","user":' || cast(user_id as varchar) || '}' as cell from events""")
def _(t: Tables):
    return tb.csv_safe(t("events").select("event_id", F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")).alias("cell")))


def _loose_orders(t: Tables):
    """Order lines with problems: line number 1 loses its item, 2 its quantity, and channel names vary."""
    return t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.when(F.col("l_linenumber") != 1, F.col("l_partkey").cast("string")).otherwise("  ").alias("sku_id"),
        (F.col("l_quantity") - F.when(F.col("l_linenumber") == 2, 25.0).otherwise(0.0)).alias("quantity"),
        F.when(F.col("l_linenumber") == 3, "phone").otherwise("store").alias("channel"), F.lit("standard").alias("priority"), F.lit("shipped").alias("status"))


@query("b01_entity_checks", """select field, count(*) as n from (select unnest(list_filter([case when l_linenumber = 1 then 'sku_id' end, case when l_linenumber = 2 and l_quantity <= 25 then 'quantity' end,
  case when l_linenumber = 3 then 'channel' end], lambda x: x is not null)) as field from lineitem) group by 1""")
def _(t: Tables):
    return en.violation_counts(_loose_orders(t), "outbound")


@query("b01_accepted_and_quarantined", """select case when bad then 'quarantined' else 'accepted' end as part, count(*) as n from (select l_linenumber in (1, 3) or (l_linenumber = 2 and l_quantity <= 25) as bad from lineitem) group by 1""")
def _(t: Tables):
    good, bad = en.split_checked(_loose_orders(t), "outbound")
    out = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, x in (("accepted", good), ("quarantined", bad))]
    return out[0].unionByName(out[1])


CONTRACT = [tb.Field("date", "time"), tb.Field("sku_id", "dimension"), tb.Field("quantity", "measure"), tb.Field("ratio", "measure", aggregate="mean")]


@query("b02_table_contract", """select unnest(['date', 'sku_id', 'quantity', 'ratio']) as field, unnest([(select count(*) from lineitem where l_linenumber = 4), 0, 0, (select count(*) from lineitem where l_linenumber = 5)]) as violations""")
def _(t: Tables):
    rows = t("lineitem").select(
        F.when(F.col("l_linenumber") == 4, F.date_format("l_shipdate", "dd.MM.yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        F.col("l_partkey").cast("string").alias("sku_id"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linenumber") == 5, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("ratio"))
    return tb.contract_violations(tb.described(rows, CONTRACT), CONTRACT)


def _catalog(t: Tables) -> tb.Catalog:
    book = tb.Catalog()
    lines = c.lines(t)
    book.register("shipped", "outbound", "warehouse", lines.where(F.col("status") == "shipped"))
    book.register("returns", "outbound", "returns desk", lines.where(F.col("status") == "cancelled"))
    book.register("stock", "inventory", "warehouse", c.inventory(t))
    return book


@query("g01_overlay", with_sql(c.lines_sql()) + """select case status when 'shipped' then 'warehouse' else 'returns desk' end as origin, count(*) as n, cast(sum(quantity) as bigint) as units from lines where quantity > 10 group by 1""")
def _(t: Tables):
    stream = _catalog(t).stream("outbound", F.col("quantity") > 10)
    return stream.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("units"))


@query("d08_registry_summary", with_sql(c.lines_sql()) + """select 'entity' as kind, 'outbound' as name, (select count(*) from lines) as n union all select 'entity', 'inventory', (select count(*) from part)
  union all select 'origin', 'warehouse', (select count(*) from lines where status = 'shipped') + (select count(*) from part) union all select 'origin', 'returns desk', (select count(*) from lines where status <> 'shipped')""")
def _(t: Tables):
    return _catalog(t).summary()


# --- numbers and times as text --------------------------------------------------------------------------------


@query("h01_number_text", """select o_orderkey, o_totalprice as dotted, o_totalprice as comma, case when o_orderkey % 3 = 0 then null else o_totalprice end as guarded, cast(case when o_totalprice = floor(o_totalprice) then o_totalprice end as bigint) as whole from orders""")
def _(t: Tables):
    text = F.format_string("%.2f", "o_totalprice")
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.concat(text, F.lit("d"))).otherwise(text)
    return t("orders").select("o_orderkey", de.number(text).alias("dotted"), de.number(F.replace(text, F.lit("."), F.lit(",")), ",").alias("comma"),
                              de.number(odd).alias("guarded"), de.whole_number(text).alias("whole"))


@query("h02_time_text", """select o_orderkey, cast(cast(o_orderdate as date) as varchar) as iso, cast(cast(o_orderdate as date) as varchar) as month_first, cast(cast(o_orderdate as date) as varchar) as day_first, cast(cast(o_orderdate as date) as varchar) as short_year from orders""")
def _(t: Tables):
    from ..functions.times import time_value

    d = F.col("o_orderdate")
    texts = {"iso": (F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), ()), "month_first": (F.date_format(d, "M/d/yyyy H:mm"), ("M/d/yyyy H:m",)),
             "day_first": (F.date_format(d, "d/M/yyyy"), ("d/M/yyyy",)), "short_year": (F.date_format(d, "MM/dd/yy HH:mm"), ("M/d/yyyy H:m", "M/d/yy H:m"))}
    return t("orders").select("o_orderkey", *[F.date_format(time_value(x, f), "yyyy-MM-dd").alias(n) for n, (x, f) in texts.items()])


@query("a03_column_facts", """select 0::bigint as "column", count(*) as n, count(distinct o_orderkey) as "distinct", true as whole, true as "numeric" from orders union all select 1, count(*), count(distinct o_orderpriority), false, false from orders
  union all select 2, count(*), count(distinct o_totalprice), bool_and(o_totalprice = floor(o_totalprice)), true from orders""")
def _(t: Tables):
    names = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    text = t("orders").select(*[F.col(n).cast("string").alias(n) for n in names], F.lit(False).alias("_malformed"))
    return rounded(de.column_facts(text, names, ".").select("column", "n", "distinct", "whole", "numeric"))


@query("a04_time_formats", """select 0::bigint as "column", true as iso, false as month_first, false as day_first union all select 1, false, true, false""")
def _(t: Tables):
    from ..functions.times import INFER_FORMATS

    text = t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.date_format("o_orderdate", "M/d/yyyy").alias("b"), F.lit(False).alias("_malformed"))
    facts = de.column_facts(text, ["a", "b"], ".")
    m, d = INFER_FORMATS.index("M/d/yyyy"), INFER_FORMATS.index("d/M/yyyy")
    return rounded(facts.select("column", "iso", F.col(f"fits{m}").alias("month_first"), F.col(f"fits{d}").alias("day_first")))


# --- a user's own dataset, policy and outcome ------------------------------------------------------------------


def _supplier_load(world: dict):
    """A user's own dataset: shipped units per supplier and month."""
    return world["lineitem"].groupBy(F.col("l_suppkey").cast("string").alias("supplier"), F.date_format(F.trunc("l_shipdate", "month"), "yyyy-MM-dd").alias("month")).agg(
        F.sum("l_quantity").alias("units"))


@query("u05_own_dataset", "select cast(l_suppkey as varchar) as supplier, cast(cast(date_trunc('month', l_shipdate) as date) as varchar) as month, sum(l_quantity) as units from lineitem group by 1, 2")
def _(t: Tables):
    fields = [tb.Field("supplier", "dimension"), tb.Field("month", "time"), tb.Field("units", "measure")]
    return tb.described(_supplier_load({"lineitem": t("lineitem")}), fields)


def _days_of_cover(profiles, days: float = 21.0):
    """A user's own policy: a fixed number of days of mean demand."""
    level = F.col("mean") * F.lit(days)
    return profiles.withColumns({"safety_stock": F.lit(0.0), "reorder_point": level, "order_up_to": level})


@query("u06_own_policy", with_sql(c.lines_sql(), c.PANEL_SQL, c.PROFILE_SQL, c.INVENTORY_SQL, "available as (select sku_id, sum(greatest(0, on_hand - reserved)) as available from inventory group by 1)") + """
  select count(*) filter (available <= mean * 21 and round_even(mean * 21 - available, 0) > 0) as skus_needing_order from profile p join available a on a.sku_id = p.sku_id""")
def _(t: Tables):
    planned = rp.plan(_days_of_cover(dm.order_profiles(c.lines(t))), c.inventory(t))
    return planned.agg(F.count_if(F.col("order_qty") > 0).alias("skus_needing_order"))
