"""Series, forecast and backtest queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import demand as dm
from ..operators import forecast as fc
from ..operators import metrics, series as se
from . import canonical as c
from .canonical import Tables, with_sql
from .registry import query, r, rounded

SUPPLIERS = [c.lines_sql("l_suppkey"), c.PANEL_SQL, c.DENSE_SQL]
SERIES_SQL = "series as (select sku_id as key, i, qty as value from dense)"
STEP_SQL = """steps as (select key, i, value, count(*) over (partition by key) as n, row_number() over (partition by key order by i) as p,
  coalesce(avg(value) over (partition by key order by i rows between unbounded preceding and 1 preceding), 0) as mean,
  coalesce(lag(value, 1) over (partition by key order by i), 0) as naive,
  coalesce(avg(value) over (partition by key order by i rows between 7 preceding and 1 preceding), 0) as ma7,
  coalesce(lag(value, 7) over (partition by key order by i), lag(value, 1) over (partition by key order by i), 0) as snaive7 from series),
tests as (select * from steps where n >= 3 and p > n - least(14, greatest(1, n // 3))),
melted as (select key, i, value as actual, unnest(['mean','naive','ma7','snaive7']) as model, unnest([mean, naive, ma7, snaive7]) as pred from tests),
errors as (select key, model, avg(abs(pred - actual)) as mae, sqrt(avg((pred - actual) * (pred - actual))) as rmse, avg(pred - actual) as bias,
  avg(case when actual > 0 then abs(pred - actual) / actual end) as mape,
  case when sum(actual) > 0 then sum(abs(pred - actual)) / sum(actual) end as wape from melted group by 1, 2)"""


def _panel(t: Tables, item: str = "l_suppkey"):
    lines = c.lines(t, item)
    return dm.item_day_demand(lines), dm.read_axis(lines)


def _series(t: Tables):
    return dm.dense(*_panel(t)).select(F.col("sku_id").alias("key"), "i", F.col("qty").alias("value"))


@query("e01_one_step_models", with_sql(*SUPPLIERS, SERIES_SQL, STEP_SQL) + """select key, i, value, round(mean, 6) as mean, naive, round(ma7, 6) as ma7, snaive7 from steps""")
def _(t: Tables):
    return rounded(se.one_step(_series(t)))


@query("e02_walk_forward", with_sql(*SUPPLIERS, SERIES_SQL, STEP_SQL) + "select key, i, actual, model, round(pred, 6) as pred from melted")
def _(t: Tables):
    return rounded(se.melt_models(se.test_part(se.one_step(_series(t)), 14), ["mean", "naive", "ma7", "snaive7"]))


@query("e03_model_comparison", with_sql(*SUPPLIERS, SERIES_SQL, STEP_SQL) + """select key, model, round(mae, 6) as mae, round(rmse, 6) as rmse,
  round(bias, 6) + 0 as bias, round(mape, 6) as mape, round(wape, 6) as wape, row_number() over (partition by key order by round(mae, 3), model) as rank from errors""")
def _(t: Tables):
    return rounded(se.compare_models(_series(t), 7, with_linear=False))


@query("d14_point_errors", with_sql(*SUPPLIERS, SERIES_SQL, STEP_SQL) + """select model, round(avg(abs(pred - actual)), 6) as mae, round(sqrt(avg((pred - actual) * (pred - actual))), 6) as rmse,
  round(avg(pred - actual), 6) + 0 as bias, round(avg(case when actual > 0 then abs(pred - actual) / actual end), 6) as mape, round(sum(abs(pred - actual)) / sum(actual), 6) as wape
  from melted group by 1""")
def _(t: Tables):
    pairs = se.melt_models(se.test_part(se.one_step(_series(t)), 14), ["mean", "naive", "ma7", "snaive7"])
    return rounded(metrics.point_errors(pairs, ["model"]))


@query("i07_seasonal_linear_steps")
def _(t: Tables):
    return rounded(metrics.point_errors(se.seasonal_linear_steps(_series(t), 7, 14), ["key", "model"]), 4)


@query("i01_daily_series", with_sql(c.lines_sql(), c.PANEL_SQL) + """select 'all' as key, cast(d.day - first_day as bigint) as i, coalesce(q, 0) as value
  from axis cross join (select cast(unnest(generate_series(first_day, last_day, interval 1 day)) as date) as day from axis) d
  left join (select day, sum(qty) as q from panel group by 1) p on p.day = d.day""")
def _(t: Tables):
    return rounded(dm.build_series(c.lines(t))[0])


def _event_orders(t: Tables):
    """Purchases and clicks as order lines with times of day."""
    return t("events").select("ts", F.lit("all").alias("sku_id"), (F.col("user_id") % 5 + 1).alias("quantity"),
                              F.when(F.col("event_type") == "error", "cancelled").otherwise("shipped").alias("status"))


@query("i01_hourly_series", """select cast(day as varchar) as day, h as hour, cast(coalesce(q, 0) as double) as qty from
  (select distinct cast(ts as date) as day from events where event_type <> 'error') cross join (select unnest(generate_series(8, 18)) as h)
  left join (select cast(ts as date) as d, hour(ts) as hh, sum(user_id % 5 + 1) as q from events where event_type <> 'error' group by 1, 2) on d = day and hh = h""")
def _(t: Tables):
    return rounded(dm.hourly_grid(_event_orders(t)))


@query("d17_cycle_profile", with_sql(*SUPPLIERS, SERIES_SQL) + """select key, i % 7 as position, round(avg(value), 6) as level, median(value) as middle from series group by 1, 2""")
def _(t: Tables):
    s = _series(t)
    mean = se.cycle_profile(s, 7)
    return rounded(mean.join(se.cycle_profile(s, 7, "median").withColumnRenamed("level", "middle"), ["key", "position"]))


RESIDUAL_SQL = """expected as (select key, i % 7 as position, median(value) as expected from series group by 1, 2),
resid as (select s.key, i, value, expected, value - expected as residual from series s join expected e on e.key = s.key and e.position = s.i % 7),
centre as (select key, median(residual) as med, count(*) as n from resid group by 1),
spread as (select r.key, any_value(med) as med, median(abs(residual - med)) as mad, avg(abs(residual - med)) as mean_abs from resid r join centre c on c.key = r.key where n >= 14 group by 1),
scales as (select *, case when mad > 0 and mad / 0.6745::double >= 1 then mad / 0.6745::double when mad = 0 and mean_abs / 0.7979::double >= 1 then mean_abs / 0.7979::double else 1.0::double end as scale,
  case when mad > 0 and mad / 0.6745::double >= 1 then 'mad' when mad = 0 and mean_abs / 0.7979::double >= 1 then 'mean_abs_dev' else 'floor' end as method from spread),
scored as (select r.*, (residual - med) / scale as robust_z, method from resid r join scales s on s.key = r.key)"""


@query("d18_robust_scale", with_sql(*SUPPLIERS, SERIES_SQL, RESIDUAL_SQL) + "select key, round(scale, 6) as scale, method from scales")
def _(t: Tables):
    return rounded(se.residual_scales(_series(t), 7))


@query("k03_item_day_scores", with_sql(*SUPPLIERS, SERIES_SQL, RESIDUAL_SQL) + """select key, i, value, expected, residual, round(robust_z, 6) + 0 as robust_z, method from scored""")
def _(t: Tables):
    return rounded(se.seasonal_residuals(_series(t), 7, together=True))


@query("k02_seasonal_anomalies", with_sql(*SUPPLIERS, SERIES_SQL, RESIDUAL_SQL) + """select key, i, value, expected, residual, round(robust_z, 6) as robust_z, method,
  case when robust_z > 0 then 'spike' else 'drop' end as direction from scored where abs(robust_z) >= 3.5""")
def _(t: Tables):
    return rounded(se.seasonal_anomalies(_series(t), 7, together=True))


@query("f03_top_anomalies", with_sql(*SUPPLIERS, SERIES_SQL, RESIDUAL_SQL) + """select key, i, value, round(robust_z, 6) as robust_z from scored where abs(robust_z) >= 3.5
  order by abs(round(robust_z, 2)) desc, key, i limit 20""")
def _(t: Tables):
    return rounded(se.top_anomalies(se.seasonal_anomalies(_series(t), 7, together=True)).select("key", "i", "value", "robust_z"))


# --- panel forecasts ---------------------------------------------------------------------------------

H, ORIGINS, STEP, LEVELS = 14, 4, 7, [0.1, 0.5, 0.9]
PATHS_SQL = f"""levels as materialized (select sku_id, i, qty, avg(qty) over w1 as mean, lag(qty) over w as naive, avg(qty) over w7 as moving from dense
  window w as (partition by sku_id order by i), w1 as (partition by sku_id order by i rows between unbounded preceding and 1 preceding),
  w7 as (partition by sku_id order by i rows between 7 preceding and 1 preceding)),
origins as (select n - {H} - j * {STEP} as origin from axis cross join (select unnest(generate_series(0, {ORIGINS - 1})) as j)),
steps as materialized (select l.sku_id, l.i, k, a.qty as actual, l.mean, l.naive, l.moving, case when l.i >= 7 then b.qty else l.naive end as cycle
  from levels l cross join (select unnest(generate_series(0, {H - 1})) as k) left join dense a on a.sku_id = l.sku_id and a.i = l.i + k
  left join dense b on b.sku_id = l.sku_id and b.i = l.i - 7 + k % 7 where l.i >= (select min(origin) - 56 from origins)),
long as materialized (select sku_id, i, k, actual, unnest(['mean','naive','moving-average','seasonal-naive']) as forecaster, unnest([mean, naive, moving, cycle]) as path from steps),
offsets as materialized (select sku_id, forecaster, origin, k, quantile_cont(actual - path, 0.1) as o10, quantile_cont(actual - path, 0.5) as o50, quantile_cont(actual - path, 0.9) as o90
  from long join origins on i < origin and i >= greatest(1, origin - 56) and i + k < origin group by 1, 2, 3, 4),
fc as materialized (select l.sku_id, l.forecaster, origin, l.k, actual, greatest(path, 0) as mean, greatest(path + o10, 0) as q10, greatest(path + o50, 0) as q50, greatest(path + o90, 0) as q90
  from long l join offsets o on o.sku_id = l.sku_id and o.forecaster = l.forecaster and o.k = l.k and o.origin = l.i)"""
BACKTEST_SQL = with_sql(*SUPPLIERS, PATHS_SQL)


def _forecasts(t: Tables, models=fc.POINT_MODELS):
    panel, axis = _panel(t)
    return fc.forecasts(panel, axis, fc.origins_of(axis, H, ORIGINS, STEP), H, LEVELS, models)


@query("e05_first_sale", with_sql(c.lines_sql(), c.PANEL_SQL) + "select sku_id, cast(min(day) as varchar) as first_sale from panel where qty > 0 group by 1")
def _(t: Tables):
    from ..operators.boosting import first_sale

    return rounded(first_sale(dm.item_day_demand(c.lines(t))))


def _path_query(name: str, model: str) -> None:
    @query(name, BACKTEST_SQL + f"select sku_id, origin, k, round(mean, 6) as mean, actual from fc where forecaster = '{model}'")
    def _(t: Tables):
        return rounded(_forecasts(t, [model]).select("sku_id", "origin", "k", "mean", "actual"))


_path_query("i02_mean_path", "mean")
_path_query("i03_naive_path", "naive")
_path_query("i04_moving_average_path", "moving-average")
_path_query("i05_seasonal_naive_path", "seasonal-naive")


@query("e10_error_quantiles", BACKTEST_SQL + "select sku_id, forecaster, origin, k, round(o10, 6) + 0 as o10, round(o50, 6) + 0 as o50, round(o90, 6) + 0 as o90 from offsets")
def _(t: Tables):
    panel, axis = _panel(t)
    paths = fc.point_paths(panel, axis, fc.origins_of(axis, H, ORIGINS, STEP), H)
    return rounded(paths.select("sku_id", "forecaster", "origin", "k", *[
        fc.array_quantile(F.col("errors"), lv).alias(n) for n, lv in (("o10", 0.1), ("o50", 0.5), ("o90", 0.9))]))


@query("i08_intervals", BACKTEST_SQL + "select sku_id, forecaster, origin, k, actual, round(mean, 6) as mean, round(q10, 6) as q10, round(q50, 6) as q50, round(q90, 6) as q90 from fc")
def _(t: Tables):
    return rounded(_forecasts(t))


SCORES_SQL = """sums as (select forecaster, case when grouping(k) = 1 then 0 else k + 1 end as days_ahead, sum(actual) as total, sum(abs(actual - mean)) as abs_err, sum(mean - actual) as diff,
  avg(abs(actual - mean)) as mae, avg((greatest(0.1::double * (actual - q10), -0.9::double * (actual - q10)) + greatest(0.5::double * (actual - q50), -0.5::double * (actual - q50))
  + greatest(0.9::double * (actual - q90), (0.9::double - 1) * (actual - q90))) / 3) as pinball, avg(case when actual > q10 and actual < q90 then 1.0::double else 0 end) as coverage_open,
  avg(case when actual >= q10 and actual <= q90 then 1.0::double else 0 end) as coverage_closed, avg(q90 - q10) as width from fc group by grouping sets ((forecaster), (forecaster, k))),
scores as (select s.forecaster, cast(s.days_ahead as bigint) as days_ahead, round(s.abs_err / s.total, 6) as wape, round(s.abs_err / r.abs_err, 6) as relative, round(s.diff / s.total, 6) + 0 as bias,
  round(s.mae, 6) as mae, round(s.pinball, 6) as pinball, round(s.coverage_open, 6) as coverage_open, round(s.coverage_closed, 6) as coverage_closed,
  round(0.8::double, 6) as nominal, round(s.width, 6) as width
  from sums s join sums r on r.forecaster = 'seasonal-naive' and r.days_ahead = s.days_ahead)"""


def _scores(t: Tables):
    panel, axis = _panel(t)
    return rounded(fc.backtest(panel, axis, H, ORIGINS, STEP, LEVELS)[0])


@query("d15_forecast_scores", with_sql(*SUPPLIERS, PATHS_SQL, SCORES_SQL) + "select * exclude (days_ahead) from scores where days_ahead = 0")
def _(t: Tables):
    return _scores(t).where(F.col("days_ahead") == 0).drop("days_ahead")


@query("d16_scores_by_days_ahead", with_sql(*SUPPLIERS, PATHS_SQL, SCORES_SQL) + "select * from scores where days_ahead > 0")
def _(t: Tables):
    return _scores(t).where(F.col("days_ahead") > 0)


@query("i10_backtest", with_sql(*SUPPLIERS, PATHS_SQL, SCORES_SQL) + "select * from scores")
def _(t: Tables):
    return _scores(t)


@query("i13_wape_by_days_ahead", with_sql(*SUPPLIERS, PATHS_SQL, SCORES_SQL) + "select forecaster, days_ahead, wape from scores where days_ahead > 0")
def _(t: Tables):
    return _scores(t).where(F.col("days_ahead") > 0).select("forecaster", "days_ahead", "wape")


@query("i13_item_forecasts", BACKTEST_SQL + """select forecaster, cast(first_day + cast(origin + k as int) as varchar) as day, actual, round(mean, 6) as mean, round(q10, 6) as q10, round(q90, 6) as q90
  from fc cross join axis where sku_id = '7' and origin = (select max(origin) from origins)""")
def _(t: Tables):
    panel, axis = _panel(t)
    last = fc.origins_of(axis, H, 1, STEP)
    mine = fc.forecasts(panel.where(F.col("sku_id") == "7"), axis, last, H, LEVELS)
    return rounded(mine.select("forecaster", F.date_add(F.lit(axis.first), (F.col("origin") + F.col("k")).cast("int")).alias("day"),
                               "actual", "mean", "q10", "q90"))


@query("i12_item_history", with_sql(*SUPPLIERS) + "select sku_id, cast(day as varchar) as day, qty from panel where sku_id = '7' and qty > 0")
def _(t: Tables):
    panel, axis = _panel(t)
    return rounded(fc.item_outlook(panel, axis, "7")[0])


@query("i12_item_outlook")
def _(t: Tables):
    panel, axis = _panel(t)
    return rounded(fc.item_outlook(panel, axis, "7")[1])


@query("i06_seasonal_linear")
def _(t: Tables):
    panel, axis = _panel(t)
    return rounded(fc.forecasts(panel, axis, fc.origins_of(axis, H, ORIGINS, STEP), H, LEVELS, ["seasonal-linear"]), 4)


@query("i10_backtest_linear")
def _(t: Tables):
    panel, axis = _panel(t)
    return rounded(fc.backtest(panel, axis, H, ORIGINS, STEP, LEVELS, [*fc.POINT_MODELS, "seasonal-linear"])[0], 4)


@query("b11_forecast_guard", BACKTEST_SQL + """select 0::bigint as missing, 0::bigint as unexpected, 0::bigint as not_finite,
  count(*) filter (mean - 5 < 0 or q50 - 2.9371::double < 0) as floored, count(*) filter (q10 > q50 - 2.9371::double) as crossed from fc where forecaster = 'mean'""")
def _(t: Tables):
    panel, axis = _panel(t)
    at = fc.origins_of(axis, H, ORIGINS, STEP)
    raw = fc.forecasts(panel, axis, at, H, LEVELS, ["mean"])
    broken = raw.withColumns({"mean": F.col("mean") - 5, "q50": F.col("q50") - 2.9371})
    return fc.guard(broken, panel, at, H, LEVELS)[1]


def _last_week(history: np.ndarray, horizon: int, levels: list[float]):
    """A user's own model: the mean of the last seven days, one unit around it."""
    level = float(history[-7:].mean())
    return np.full(horizon, level), {lv: np.full(horizon, level + (lv - 0.5) * 2) for lv in levels}


@query("u01_own_forecaster", BACKTEST_SQL + "select sku_id, origin, k, round(mean, 6) as mean, actual from fc where forecaster = 'moving-average'")
def _(t: Tables):
    panel, axis = _panel(t)
    at = fc.origins_of(axis, H, ORIGINS, STEP)
    own = fc.own_forecaster(panel, axis, at, H, LEVELS, "last-week", _last_week)
    return rounded(fc.guard(own, panel, at, H, LEVELS)[0].select("sku_id", "origin", "k", "mean", "actual"))
