"""Causal and paired-effect queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal as ca
from ..operators import studies as st
from .canonical import Tables, with_sql
from .registry import query, r, rounded

ORDER_ROWS = """rows as (select o_orderkey, cast(o_orderpriority = '1-URGENT' as int) as urgent, o_totalprice as price, c_acctbal as balance, c_mktsegment as segment
  from orders join customer on o_custkey = c_custkey)"""
Q_ALL = ca.Question("urgent", "price", ("balance", "segment"))
Q_ONE = ca.Question("urgent", "price", ("balance",))


def _rows(t: Tables):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), F.col("o_totalprice").alias("price"),
                         F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def _one(spark, row: tuple):
    return spark.createDataFrame([row], ca.ESTIMATE)


WELCH = """select n1.m - n0.m as effect, sqrt(n1.v / n1.n + n0.v / n0.n) as se, n1.n as n_treated, n0.n as n_control from
  (select avg(price) as m, var_samp(price) as v, count(*) as n from rows where urgent = 1) n1 cross join (select avg(price) as m, var_samp(price) as v, count(*) as n from rows where urgent = 0) n0"""


@query("d26_arm_means", with_sql(ORDER_ROWS) + "select cast(urgent as bigint) as treated, count(*) as n, round(avg(price), 4) as mean, round(var_samp(price) / 1e6, 4) as variance from rows group by 1")
def _(t: Tables):
    return rounded(ca.arm_means(ca.design(_rows(t), Q_ALL)).withColumn("variance", F.col("variance") / 1e6), 4)


@query("l04_difference_in_means", with_sql(ORDER_ROWS) + f"select 'difference-in-means' as estimator, round(effect, 4) as effect, round(se, 4) as std_error, n_treated, n_control from ({WELCH})")
def _(t: Tables):
    d = ca.design(_rows(t), Q_ALL)
    return rounded(_one(t.spark, ca.difference_in_means(d)).select("estimator", "effect", "std_error", "n_treated", "n_control"), 4)


@query("l02_design", with_sql(ORDER_ROWS) + """select count(*) as n, sum(urgent)::double as treated, round(avg(balance), 6) as balance, sum(cast(segment = 'BUILDING' as int))::double as building,
  sum(cast(segment = 'FURNITURE' as int))::double as furniture, sum(cast(segment = 'HOUSEHOLD' as int))::double as household, sum(cast(segment = 'MACHINERY' as int))::double as machinery from rows""")
def _(t: Tables):
    d = ca.design(_rows(t), Q_ALL)
    at = {name: col for name, col in zip(d.names, d.columns)}
    shown = {s.lower(): F.sum(at[f"segment={s}"]) for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    return rounded(d.rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_t").alias("treated"), F.avg(at["balance"]).alias("balance"),
                              *[v.alias(k) for k, v in shown.items()]))


OLS = """centred as (select urgent - avg(urgent) over () as t, balance - avg(balance) over () as x, price - avg(price) over () as y from rows),
moments as (select sum(t * t) as tt, sum(x * x) as xx, sum(t * x) as tx, sum(t * y) as ty, sum(x * y) as xy, count(*) as n from centred),
fit as (select (ty * xx - xy * tx) / (tt * xx - tx * tx) as bt, (xy * tt - ty * tx) / (tt * xx - tx * tx) as bx, tx / xx as g, n from moments),
parts as (select t - g * x as tr, y - bt * t - bx * x as e, bt, n from centred cross join fit)"""


@query("l05_regression_adjustment", with_sql(ORDER_ROWS, OLS) + """select 'regression-adjustment' as estimator, round(any_value(bt), 3) as effect,
  round(sqrt(sum(tr * tr * e * e) / (sum(tr * tr) * sum(tr * tr)) * any_value(n) / (any_value(n) - 3)), 3) as std_error from parts""")
def _(t: Tables):
    d = ca.design(_rows(t), Q_ONE)
    return rounded(_one(t.spark, ca.regression_adjustment(d)).select("estimator", "effect", "std_error"), 3)


@query("l03_identification", with_sql(ORDER_ROWS) + """, asked as (select *, 2 * balance as twice, 5.0 as constant, 20000 + (o_orderkey % 11) / 10.0 - 0.5 as narrow, balance as same, balance + o_orderkey as other from rows)
  select 'none' as extra, case when var_pop(balance) > 0 then 'identified' end as answer from asked
  union all select 'twice', case when regr_r2(twice, balance) > 1 - 1e-9 then 'not identified: twice is ' || cast(cast(round(regr_slope(twice, balance)) as int) as varchar) || ' x balance' else 'identified' end from asked
  union all select 'constant', case when var_pop(constant) = 0 then 'not identified: constant is constant' else 'identified' end from asked
  union all select 'narrow', case when var_pop(narrow) > 0 and regr_r2(narrow, balance) < 0.999 then 'identified' end from asked
  union all select 'same', case when max(abs(same - balance)) = 0 then 'not identified: same equals balance' else 'identified' end from asked
  union all select 'other', case when regr_r2(other, balance) < 0.999 then 'identified' end from asked""")
def _(t: Tables):
    key = F.col("o_orderkey")
    rows = _rows(t).withColumns({"twice": F.col("balance") * 2, "constant": F.lit(5.0), "narrow": 20000 + (key % 11) / 10.0 - 0.5,
                                 "same": F.col("balance"), "other": F.col("balance") + key})
    out = []
    for extra in ("none", "twice", "constant", "narrow", "same", "other"):
        try:
            d = ca.design(rows, ca.Question("urgent", "price", ("balance", *([extra] if extra != "none" else []))))
            ca.identify(d, ca.scaled(d))
            out.append((extra, "identified"))
        except ValueError as problem:
            out.append((extra, str(problem)))
    return t.spark.createDataFrame(out, "extra string, answer string")


@query("l06_ipw")
def _(t: Tables):
    d = ca.design(_rows(t), Q_ALL, ("o_orderkey",))
    return rounded(_one(t.spark, ca.ipw(d, ("o_orderkey",))).drop("method", "error"), 3)


@query("l07_score_estimators")
def _(t: Tables):
    return rounded(ca.score_estimators(_rows(t), Q_ALL, ("o_orderkey",)), 3)


def _own(d: ca.Design, confidence: float):
    """A user's own estimator: the plain difference, without an interval."""
    arms = {row.treated: row.mean for row in ca.arm_means(d).collect()}
    return arms[1] - arms[0], None, None


@query("u03_own_estimator", with_sql(ORDER_ROWS) + f"select 'plain-difference' as estimator, round(effect, 4) as effect, n_treated, n_control from ({WELCH})")
def _(t: Tables):
    found = ca.score_estimators(_rows(t), Q_ALL, ("o_orderkey",), own={"plain-difference": _own}, names=())
    return rounded(found.select("estimator", "effect", "n_treated", "n_control"), 4)


# --- paired effects over the order table: years are replicates, priorities are arms ---------------------

VALUES_SQL = """vals as (select cast(year(o_orderdate) as int) as replicate, case when o_orderpriority = '5-LOW' then 'baseline' else o_orderpriority end as arm,
  o_orderstatus as policy, 'mean_price' as metric, avg(o_totalprice) as value from orders group by 1, 2, 3),
paired as (select v.*, b.value as base, v.value - b.value as difference from vals v join vals b on b.arm = 'baseline' and b.replicate = v.replicate and b.policy = v.policy where v.arm <> 'baseline')"""


def _values(t: Tables):
    arm = F.when(F.col("o_orderpriority") == "5-LOW", "baseline").otherwise(F.col("o_orderpriority"))
    return t("orders").groupBy(F.year("o_orderdate").alias("replicate"), arm.alias("arm"), F.col("o_orderstatus").alias("policy")).agg(
        F.avg("o_totalprice").alias("value")).withColumn("metric", F.lit("mean_price"))


@query("c08_paired_arms", with_sql(VALUES_SQL) + "select cast(replicate as bigint) as replicate, arm, policy, metric, round(value, 4) as value, round(base, 4) as base, round(difference, 4) as difference from paired")
def _(t: Tables):
    return rounded(st.pair_arms(_values(t)), 4)


@query("d27_paired_effects", with_sql(VALUES_SQL) + """select arm, policy, metric, round(avg(base), 4) as baseline_mean, round(avg(value), 4) as arm_mean, round(avg(difference), 4) as effect,
  count(*) as n, round(avg(difference) / avg(base), 6) as relative, round(avg(difference) - 2.4469118511449692 * stddev_samp(difference) / sqrt(count(*)), 3) as low,
  round(avg(difference) + 2.4469118511449692 * stddev_samp(difference) / sqrt(count(*)), 3) as high from paired group by 1, 2, 3""")
def _(t: Tables):
    return rounded(st.paired_effects(_values(t), 7).withColumn("relative", F.round("relative", 6)).select(
        "arm", "policy", "metric", r("baseline_mean", 4).alias("baseline_mean"), r("arm_mean", 4).alias("arm_mean"), r("effect", 4).alias("effect"), "n", "relative", r("low", 3).alias("low"), r("high", 3).alias("high")))


SCORES_SQL = WELCH.replace("n1.n as n_treated, n0.n as n_control", "1000.0 as truth")


@query("d29_estimator_scores", with_sql(ORDER_ROWS, OLS) + f"""select estimator, round(effect, 3) as effect, truth, round(effect - truth, 3) as bias, round((effect - truth) / abs(truth), 6) as relative_bias,
  abs(effect - truth) <= 1.96 * se as covers from (select 'difference-in-means' as estimator, * from ({SCORES_SQL}) union all
  select 'regression-adjustment', any_value(bt), sqrt(sum(tr * tr * e * e) / (sum(tr * tr) * sum(tr * tr)) * any_value(n) / (any_value(n) - 3)), 1000.0 from parts)""")
def _(t: Tables):
    found = ca.score_estimators(_rows(t), Q_ONE, ("o_orderkey",), 1000.0, names=("difference-in-means", "regression-adjustment"))
    return found.select("estimator", r("effect", 3).alias("effect"), "truth", r("bias", 3).alias("bias"), r("relative_bias", 6).alias("relative_bias"), "covers")


@query("c12_policy_grid", """select p_partkey, arm, policy from part cross join (select unnest(['baseline', 'promo_spike']) as arm) cross join (select unnest(['naive', 'service-level']) as policy)""")
def _(t: Tables):
    grid = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(p).alias("policy")) for a in ("baseline", "promo_spike") for p in ("naive", "service-level")])
    return t("part").select("p_partkey", F.explode(grid).alias("g")).select("p_partkey", "g.*")
