"""Fidelity, privacy, synthesis and benchmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demand as dm
from ..operators import fidelity as fi
from ..operators import series as se
from ..operators import synth as sy
from ..operators import utility as ut
from ..session import cut
from . import canonical as c
from .canonical import Tables, with_sql
from .forecasting import SERIES_SQL, SUPPLIERS, _series
from .registry import query, rounded

COLUMNS = ["l_quantity", "l_discount", "l_tax"]
KINDS = {"l_quantity": "integer", "l_discount": "category", "l_tax": "real"}
SPLIT = "cast((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709 + l_linenumber * 15485863) % 1000003 % 2 as int)"
BOTH_SQL = f"both_rows as (select l_quantity, l_discount, l_tax, {SPLIT} as side from lineitem)"


def _both(t: Tables):
    return t("lineitem").select(*COLUMNS, F.expr(SPLIT).alias("side"))


def _ks_sql(source: str, keys: str = "key", value: str = "value") -> str:
    return f"""counts as (select {keys}, {value} as x, count(*) filter (side = 0) as a, count(*) filter (side = 1) as b from {source} group by 1, 2),
  running as (select {keys}, sum(a) over w / sum(a) over (partition by {keys}) as fa, sum(b) over w / sum(b) over (partition by {keys}) as fb from counts
  window w as (partition by {keys} order by x)), ks as (select {keys}, round(max(abs(fa - fb)), 4) as ks from running group by 1)"""


MELTED_SQL = "melted as (select side, unnest(['l_quantity','l_discount','l_tax']) as key, unnest([l_quantity, l_discount, l_tax]) as value from both_rows)"


@query("d20_ks", with_sql(BOTH_SQL, MELTED_SQL, _ks_sql("melted")) + 'select key as "column", ks from ks')
def _(t: Tables):
    return fi.ks(fi.melt_columns(_both(t), COLUMNS, ["side"]), ["column"], "value", "side")


@query("d21_pearson", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r, 0.0::double as flat from lineitem group by 1")
def _(t: Tables):
    li = t("lineitem").withColumn("one", F.lit(1.0))
    return rounded(li.groupBy("l_returnflag").agg(fi.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("r"),
                                                  fi.pearson(F.col("l_quantity"), F.col("one")).alias("flat")))


PAIRED_SQL = """paired as (select key, i, value, 0 as side from series union all select key, i, lag(value, 7, 0) over (partition by key order by i), 1 from series)"""
MOMENTS_SQL = """moments as (select key, avg(value) filter (side = 0) as rm, avg(value) filter (side = 1) as sm, stddev_pop(value) filter (side = 0) as rs, stddev_pop(value) filter (side = 1) as ss from paired group by 1),
cycle as (select key, i % 7 as p, avg(value) filter (side = 0) as a, avg(value) filter (side = 1) as b from paired group by 1, 2),
shape as (select key, round(corr(a, b), 4) as pc from cycle group by 1)"""


@query("d19_series_fidelity", with_sql(*SUPPLIERS, SERIES_SQL, PAIRED_SQL, MOMENTS_SQL, _ks_sql("paired")) + """select m.key, ks, pc as profile_corr, round(100 * (sm - rm) / rm, 2) + 0 as mean_delta_pct,
  round(100 * (ss - rs) / rs, 2) + 0 as std_delta_pct, round(rm, 2) as real_mean, round(sm, 2) as synth_mean, round(100 * (1 - ks) * greatest(0, pc), 1) as fidelity_score
  from moments m join shape s on s.key = m.key join ks on ks.key = m.key""")
def _(t: Tables):
    s = _series(t)
    moved = se.lagged(s, 7, together=True)
    both = s.withColumn("side", F.lit(0)).unionByName(moved.withColumn("side", F.lit(1)))
    return rounded(fi.series_fidelity(both, 7), 4)


@query("d23_table_fidelity", with_sql(BOTH_SQL, MELTED_SQL, _ks_sql("melted"), """trend as (select 1 - abs(corr(l_quantity, l_discount) filter (side = 0) - corr(l_quantity, l_discount) filter (side = 1)) / 2 as qd,
  1 - abs(corr(l_quantity, l_tax) filter (side = 0) - corr(l_quantity, l_tax) filter (side = 1)) / 2 as qt from both_rows)""") + """select round(qd, 4) as "l_quantity~l_discount", round(qt, 4) as "l_quantity~l_tax",
  round((select avg(1 - ks) from ks), 4) as column_shape_score, round((qd + qt) / 2, 4) as pair_trend_score, round((round((select avg(1 - ks) from ks), 4) + round((qd + qt) / 2, 4)) / 2, 4) as overall from trend""")
def _(t: Tables):
    return fi.table_fidelity(_both(t), COLUMNS, [("l_quantity", "l_discount"), ("l_quantity", "l_tax")])


@query("d24_shared_histogram", with_sql("""v as (select o_totalprice as x, cast(o_orderkey % 3 = 0 as int) as side from orders)""",
  "q as (select quantile_cont(x, 0.01) filter (side = 0) as a, quantile_cont(x, 0.99) filter (side = 0) as b from v)",
  "placed as (select side, least(11, greatest(0, cast(floor((x - a) / ((b - a) / 12)) as int))) as bin from v cross join q)") + """select bin::bigint as bin, round(any_value(a + bin * ((b - a) / 12)), 4) as low,
  round(count(*) filter (side = 0) / (select count(*) from v where side = 0), 6) as real, round(count(*) filter (side = 1) / (select count(*) from v where side = 1), 6) as synthetic from placed cross join q group by 1""")
def _(t: Tables):
    both = t("orders").select("o_totalprice", (F.col("o_orderkey") % 3 == 0).cast("int").alias("side"))
    shown = fi.shared_histogram(both, "o_totalprice")
    return rounded(shown.select("bin", F.round("low", 4).alias("low"), "real", "synthetic"))


@query("d24_whole_histogram", with_sql("v as (select p_size % 20 as x, cast(p_partkey % 3 = 0 as int) as side from part)") + """select (x - (select min(x) from v where side = 0))::bigint as bin, (x - 0.5)::double as low,
  round(count(*) filter (side = 0) / (select count(*) from v where side = 0), 6) as real, round(count(*) filter (side = 1) / (select count(*) from v where side = 1), 6) as synthetic from v group by x""")
def _(t: Tables):
    both = t("part").select((F.col("p_size") % 20).alias("x"), (F.col("p_partkey") % 3 == 0).cast("int").alias("side"))
    return rounded(fi.shared_histogram(both, "x"))


MI_SQL = """pairs as (select unnest([0, 0, 1]) as a, unnest([1, 2, 2]) as b, unnest([l_quantity, l_quantity, l_discount]) as ca, unnest([l_discount, l_tax, l_tax]) as cb from lineitem),
joint as (select a, b, ca, cb, count(*) as n from pairs group by 1, 2, 3, 4)"""


@query("d25_mutual_information", with_sql(MI_SQL) + """select a::bigint as a, b::bigint as b, round(sum(n / t * ln(n * t / (na * nb))), 8) as mi from (select *, sum(n) over (partition by a, b)::double as t,
  sum(n) over (partition by a, b, ca)::double as na, sum(n) over (partition by a, b, cb)::double as nb from joint) group by 1, 2""")
def _(t: Tables):
    return rounded(fi.mutual_information(t("lineitem").select(*COLUMNS), COLUMNS), 8)


@query("h13_min_max", with_sql(BOTH_SQL, "e as (select min(l_quantity) as a, max(l_quantity) as b, min(l_discount) as c, max(l_discount) as d from both_rows)") + """select side::bigint as side, round((l_quantity - a) / (b - a), 6) as q,
  round((l_discount - c) / (d - c), 6) as d, count(*) as n from both_rows cross join e group by 1, 2, 3""")
def _(t: Tables):
    scaled = rounded(fi.normalised(_both(t), COLUMNS))
    return scaled.groupBy("side", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")).agg(F.count(F.lit(1)).alias("n"))


NEAR_SQL = with_sql("""b as (select o_totalprice as x, c_acctbal as y, cast(o_orderkey % 2 as int) as side from orders join customer on o_custkey = c_custkey)""",
  "e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from b)", "s as (select (x - x0) / (x1 - x0) as x, (y - y0) / (y1 - y0) as y, side from b cross join e)",
  "reals as materialized (select x, y, count(*) as n from s where side = 0 group by 1, 2)", "synth as materialized (select x, y, count(*) as m from s where side = 1 group by 1, 2)",
  """near as (select q.x, q.y, any_value(m) as m, list_sort(list(sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)))) as d, any_value(n) as n
  from synth q cross join reals r group by 1, 2)""")


def _points(t: Tables):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_totalprice").alias("x"), F.col("c_acctbal").alias("y"), (F.col("o_orderkey") % 2).cast("int").alias("side"))


NEAR2_SQL = with_sql("""b as (select o_totalprice as x, c_acctbal as y, cast(o_orderkey % 2 as int) as side from orders join customer on o_custkey = c_custkey)""",
  "e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from b)", "s as (select (x - x0) / (x1 - x0) as x, (y - y0) / (y1 - y0) as y, side from b cross join e)",
  "reals as materialized (select x, y, count(*) as n from s where side = 0 group by 1, 2)", "synth as materialized (select x, y, count(*) as m from s where side = 1 group by 1, 2)",
  """near as materialized (select q.x, q.y, any_value(m) as m, min(sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)), 2) as d,
  arg_min(n, sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y))) as n from synth q cross join reals r group by 1, 2)""",
  "pairs as (select x, y, m, d[1] as d1, case when n > 1 then d[1] else d[2] end as d2 from near)")


@query("c09_two_nearest", NEAR2_SQL + "select round(x, 6) as x, round(y, 6) as y, m, round(d1, 6) as d1, round(d2, 6) as d2 from pairs")
def _(t: Tables):
    return rounded(fi.nearest_distances(_points(t), ["x", "y"]))


@query("d22_privacy_report", NEAR2_SQL + """, rows as (select d1, case when d2 > 0 then d1 / d2 else 1 end as nndr from pairs cross join lateral (select unnest(generate_series(1, m)))),
  o as (select d1, row_number() over (order by d1) as k, count(*) over () as n from rows)
  select (select count(*) from rows) as n_synth, 2::bigint as dims, round((select median(d1) from rows), 4) as dcr_median, round((select d1 from o where k = greatest(0, cast(floor(0.05 * n) as int) - 1) + 1), 4) as dcr_p05,
  round((select median(nndr) from rows), 4) as nndr_median, round(100 * (select count(*) from rows where d1 < 0.02) / (select count(*) from rows), 2) as clone_risk_pct,
  case when (select d1 from o where k = greatest(0, cast(floor(0.05 * n) as int) - 1) + 1) > 0.02 then 'low leakage risk' else 'review: some synthetic rows are close to real rows' end as verdict""")
def _(t: Tables):
    return rounded(fi.privacy_report(_points(t), ["x", "y"]), 4)


@query("g03_side_by_side", with_sql(BOTH_SQL) + "select case side when 0 then 'real' else 'synthetic' end as origin, side::bigint as side, count(*) as n, sum(l_quantity) as q from both_rows group by 1, 2")
def _(t: Tables):
    both = _both(t)
    parts = [both.where(F.col("side") == s).select(*COLUMNS) for s in (0, 1)]
    return rounded(ut.side_by_side(*parts).groupBy("origin", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")))


@query("b14_apply_kinds", """with levels as (select distinct p_retailprice as v from part), lo as (select min(p_size) as a, max(p_size) as b from part),
  asked as (select distinct o_orderkey, o_totalprice / 300 + 600 as x, o_totalprice / 10000 - 3 as s from orders),
  near as (select o_orderkey, any_value(x) as x, any_value(s) as s, max(v) filter (v <= x) as below, min(v) filter (v >= x) as above from asked cross join levels group by 1)
  select o_orderkey, case when below is null then above when above is null then below when x - below <= above - x then below else above end as price,
  least(greatest(round_even(s, 0), a), b)::double as size from near cross join lo""")
def _(t: Tables):
    fitted = t("part").select(F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    sample = t("orders").select("o_orderkey", (F.col("o_totalprice") / 300 + 600).alias("price"), (F.col("o_totalprice") / 10000 - 3).alias("size"))
    return sy.apply_kinds(sample, fitted, {"price": "category", "size": "integer"})


@query("b15_sample_check", "select 0::bigint as l_quantity, 0::bigint as l_discount, 0::bigint as l_tax")
def _(t: Tables):
    return sy.check_sample(t("lineitem").select(*COLUMNS), COLUMNS)


# --- generators ------------------------------------------------------------------------------------------


@query("m03_seasonal_series")
def _(t: Tables):
    return rounded(sy.sample_seasonal(sy.fit_seasonal(_series(t), 7, together=True), 7))


@query("m04_hourly_series")
def _(t: Tables):
    orders = t("events").select("ts", F.lit("all").alias("sku_id"), (F.col("user_id") % 5 + 1).alias("quantity"), F.lit("shipped").alias("status"))
    grid = dm.hourly_grid(orders)
    series = grid.select(F.lit("all").alias("key"), (F.dense_rank().over(_day_order()) * 11 - 11 + F.col("hour") - 8).cast("bigint").alias("i"), F.col("qty").alias("value"))
    return rounded(sy.sample_seasonal(sy.fit_seasonal(series, 11), 11))


def _day_order():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit("all")).orderBy("day")  # one row per business hour of the axis


@query("m05_bootstrap_table")
def _(t: Tables):
    return rounded(sy.bootstrap_table(t("lineitem").select(*COLUMNS), COLUMNS, KINDS))


@query("m06_bayesian_network")
def _(t: Tables):
    return rounded(sy.bayesian_network_table(t("lineitem").select(*COLUMNS), COLUMNS, KINDS))


@query("m06_quantile_bins", """with e as (select list_distinct(quantile_cont(l_extendedprice, [k / 20 for k in generate_series(1, 19)])) as edges from lineitem)
  select len(list_filter(edges, lambda x: x <= l_extendedprice))::double as bin, count(*) as n from lineitem cross join e group by 1""")
def _(t: Tables):
    coded = sy.bin_columns(t("lineitem").select("l_extendedprice"), ["l_extendedprice"], {})[0]
    return coded.groupBy(F.col("b_l_extendedprice").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("c11_conditional_table", """with j as (select l_discount as parent, l_tax as child, count(*) as n from lineitem group by 1, 2), d as (select count(distinct child) as size from j),
  g as (select p.parent, c.child, coalesce(j.n, 0) + 1.0::double / size as w from (select distinct parent from j) p cross join (select distinct child from j) c cross join d left join j on j.parent = p.parent and j.child = c.child)
  select parent, child, round(sum(w) over (partition by parent order by child) / sum(w) over (partition by parent), 6) as cumulative from g""")
def _(t: Tables):
    columns = ["l_discount", "l_tax"]
    coded, edges = sy.bin_columns(t("lineitem").select(*columns), columns, {})
    table = sy.conditional_table(sy.Network(columns, [None, 0], [0, 1], coded, edges), 1)
    return rounded(table)


@query("m07_gaussian_copula")
def _(t: Tables):
    return rounded(sy.gaussian_copula_table(t("lineitem").select(*COLUMNS), COLUMNS, KINDS))


@query("m09_evaluate_table")
def _(t: Tables):
    return ut.evaluate_table(t("part").select("p_size", "p_retailprice"), ["p_size", "p_retailprice"], {"p_size": "integer", "p_retailprice": "real"}, "bayesian-network")


@query("m09_evaluate_series")
def _(t: Tables):
    return rounded(ut.evaluate_series(_series(t), 7), 4)


@query("m10_detection_test")
def _(t: Tables):
    columns = ["price", "month", "weekday"]
    real = t("orders").select(F.col("o_totalprice").cast("double").alias("price"), F.month("o_orderdate").cast("double").alias("month"),
                              F.weekday("o_orderdate").cast("double").alias("weekday"))
    fake = sy.bootstrap_table(real, columns, {"month": "category", "weekday": "category"})
    return ut.detection_report(cut(ut.side_by_side(real, fake)), columns)


@query("m11_tstr")
def _(t: Tables):
    return rounded(ut.tstr(_series(t), 7, together=True), 4)


def _copies(real, columns, kinds, seed):
    """A user's own synthesizer: a shifted copy."""
    return real.select(*[(F.col(c) + 1).alias(c) for c in columns])


@query("u04_own_synthesizer")
def _(t: Tables):
    return ut.evaluate_table(t("part").select("p_size", "p_retailprice"), ["p_size", "p_retailprice"], {}, _copies, detection=False)
