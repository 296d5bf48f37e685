"""Pivot queries over the order-lines dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi, pivot as pv
from ..operators.pivot import View
from . import canonical as c
from .canonical import Tables, with_sql
from .portfolio import LINE_SQL
from .registry import query, rounded

BASE = [c.OUTBOUND_SQL, c.SKU_SQL, LINE_SQL]


def _lines(t: Tables):
    return kpi.order_lines(c.outbound(t), c.sku(t))


def _result(t: Tables, view: View, digits: int = 6):
    return rounded(pv.pivot(_lines(t), view), digits)


def cube_sql(rows: list[str], cols: list[str], values: list[str], where: str = "true") -> str:
    """Grouping sets over ``order_lines`` for row and column key expressions and value expressions."""
    keys = [f"({e}) as r{i + 1}" for i, e in enumerate(rows)] + [f"({e}) as c{i + 1}" for i, e in enumerate(cols)]
    rn, cn = [f"r{i + 1}" for i in range(len(rows))], [f"c{i + 1}" for i in range(len(cols))]
    sets = [rn[:d] + tail for d in range(len(rn) + 1) for tail in ([[], cn] if cn else [[]])]
    depth = " + ".join(f"(1 - grouping({k}))" for k in rn) or "0"
    cell = f"grouping({cn[0]}) = 0" if cn else "false"
    return (f"select cast({depth} as bigint) as depth, {cell} as cell, {', '.join(rn + cn)}, count(*) as n"
            + "".join(f", {v} as v{i + 1}" for i, v in enumerate(values))
            + f" from (select *, {', '.join(keys)} from order_lines where {where}) group by grouping sets ("
            + ", ".join("(" + ", ".join(s) + ")" for s in sets) + ")")


MONTH, YEAR, DOW = "substr(date, 1, 7)", "substr(date, 1, 4)", "strftime(cast(date as date), '%a')"


@query("b03_filters", with_sql(*BASE) + """select channel, status, count(*) as n from order_lines where channel in ('store', 'wholesale')
  and not (status in ('cancelled')) group by 1, 2""")
def _(t: Tables):
    rules = {"channel": {"include": ["store", "wholesale", None]}, "status": {"exclude": ["cancelled"]}}
    return pv.apply_filters(_lines(t), rules).groupBy("channel", "status").agg(F.count(F.lit(1)).alias("n"))


@query("d09_aggregates", with_sql(*BASE) + """select 0::bigint as depth, false as cell, count(*) as n, cast(sum(quantity) as double) as v1, cast(count(*) as double) as v2,
  cast(count(distinct sku_id) as double) as v3, round(avg(line_value), 6) as v4, median(line_value) as v5, min(line_value) as v6, max(line_value) as v7 from order_lines""")
def _(t: Tables):
    return _result(t, View(values=[("quantity", "sum"), ("quantity", "count"), ("sku_id", "count_distinct"), ("line_value", "mean"),
                                   ("line_value", "median"), ("line_value", "min"), ("line_value", "max")]))


@query("d10_pivot", with_sql(*BASE) + cube_sql(["abc_class", "channel"], [YEAR], [
    "cast(sum(quantity) as double)", "cast(count(distinct sku_id) as double)", "round(avg(quantity), 6)", "cast(median(quantity) as double)"]))
def _(t: Tables):
    return _result(t, View(rows=["abc_class", "channel"], columns=[("date", "year")],
                           values=[("quantity", "sum"), ("sku_id", "count_distinct"), ("quantity", "mean"), ("quantity", "median")]))


@query("d10_pivot_weekday", with_sql(*BASE) + cube_sql([MONTH], [DOW], ["cast(sum(quantity) as double)", "cast(count(*) as double)"], "status <> 'cancelled'"))
def _(t: Tables):
    return _result(t, View(rows=[("date", "month")], columns=[("date", "weekday")], values=[("quantity", "sum"), ("quantity", "count")],
                           filters={"status": {"exclude": ["cancelled"]}}))


def _share_sql(whole: str) -> str:
    return with_sql(*BASE, "cube as (" + cube_sql(["abc_class"], ["channel"], ["cast(sum(quantity) as double)"]) + ")") + f"""
  select a.depth, a.cell, a.r1, a.c1, a.n, round(a.v1 / nullif(({whole}), 0), 6) as v1 from cube a"""


GRAND = "select b.v1 from cube b where b.depth = 0 and not b.cell"


@query("d11_share_of_total", _share_sql(GRAND))
def _(t: Tables):
    return _result(t, View(rows=["abc_class"], columns=["channel"], values=[("quantity", "sum")], show_as="share_of_total"))


@query("d11_share_of_row", _share_sql("select b.v1 from cube b where b.depth = a.depth and not b.cell and b.r1 is not distinct from a.r1"))
def _(t: Tables):
    return _result(t, View(rows=["abc_class"], columns=["channel"], values=[("quantity", "sum")], show_as="share_of_row"))


@query("d11_share_of_column", _share_sql("select b.v1 from cube b where b.depth = 0 and b.cell = a.cell and b.c1 is not distinct from a.c1"))
def _(t: Tables):
    return _result(t, View(rows=["abc_class"], columns=["channel"], values=[("quantity", "sum")], show_as="share_of_column"))


@query("d12_distinct_values", with_sql(*BASE) + "select category as value, count(*) as n from order_lines group by 1")
def _(t: Tables):
    return pv.distinct_values(_lines(t), "category")


@query("d12_kept_count", with_sql(*BASE) + "select count(distinct sku_id) filter (sku_id not in ('1', '2', '3')) as kept from order_lines")
def _(t: Tables):
    return pv.kept_count(pv.distinct_values(_lines(t), "sku_id"), {"exclude": ["1", "2", "3"]})


FOLD_SQL = with_sql(*BASE, f"""totals as (select {MONTH} as c, sum(quantity) as q from order_lines group by 1),
kept as (select c from totals order by abs(q) desc, c limit 9)""") + cube_sql(
    ["channel"], [f"case when {MONTH} in (select c from kept) then {MONTH} else 'Other' end"], ["cast(sum(quantity) as double)", "cast(count(distinct sku_id) as double)"])


@query("d13_folded_columns", FOLD_SQL)
def _(t: Tables):
    return _result(t, View(rows=["channel"], columns=[("date", "month")], values=[("quantity", "sum"), ("sku_id", "count_distinct")], max_columns=10))


@query("f06_label_order", """select p_brand as label, string_agg(case when regexp_matches(s, '^[0-9]') then lpad(s, 20, '0') else s end, '' order by i) as label_key, count(*) > 0 as used
  from (select p_brand, unnest(regexp_extract_all(p_brand, '([0-9]+|[^0-9]+)')) as s, unnest(generate_series(1, len(regexp_extract_all(p_brand, '([0-9]+|[^0-9]+)')))) as i
  from (select distinct p_brand from part)) group by 1""")
def _(t: Tables):
    return t("part").select("p_brand").distinct().select(
        F.col("p_brand").alias("label"), pv.natural_key(F.col("p_brand")).alias("label_key"), F.lit(True).alias("used"))


@query("f06_pivot_order", with_sql(*BASE) + """select category as r1, channel as r2, cast(sum(quantity) as double) as v1 from order_lines group by 1, 2
  union all select category, null, sum(quantity) from order_lines group by 1 union all select null, null, sum(quantity) from order_lines""")
def _(t: Tables):
    view = View(rows=["category", "channel"], columns=["abc_class"], values=[("quantity", "sum")])
    return pv.ordered(pv.pivot(_lines(t), view), 2, "value", descending=True).select("r1", "r2", "v1")


@query("a13_head", with_sql(*BASE) + """select *, (select count(*) from order_lines) as total_rows from order_lines
  order by date, sku_id, quantity, line_value, channel, priority, status limit 100""")
def _(t: Tables):
    from ..sources.tables import head

    return rounded(head(_lines(t), 100, ["date", "sku_id", "quantity", "line_value", "channel", "priority", "status"]), 2)


@query("a14_pivot_table", with_sql(*BASE) + """select case when grouping(abc_class) = 1 then 'Total' else abc_class end as label,
  cast(sum(quantity) filter (channel = 'ecommerce') as double) as ecommerce, cast(sum(quantity) filter (channel = 'store') as double) as store,
  cast(sum(quantity) filter (channel = 'wholesale') as double) as wholesale, cast(sum(quantity) as double) as total
  from order_lines group by grouping sets ((), (abc_class))""")
def _(t: Tables):
    view = View(rows=["abc_class"], columns=["channel"], values=[("quantity", "sum")])
    shown = pv.wide(pv.pivot(_lines(t), view), 1, 1)
    return shown.select(F.when(F.col("depth") == 0, "Total").otherwise(F.col("r1")).alias("label"),
                        "ecommerce", "store", "wholesale", F.col("Total").alias("total"))
