"""Detector, injection and boosted-forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as bo
from ..operators import demand as dm
from ..operators import detect as de
from ..operators import forecast as fc
from ..operators import metrics
from ..operators import replenish as rp
from . import canonical as c
from .canonical import Tables, with_sql
from .forecasting import H, LEVELS, ORIGINS, RESIDUAL_SQL, SERIES_SQL, STEP, SUPPLIERS, _panel, _series
from .registry import query, r, rounded


#: Days of items that one task replays.
TASK_ROWS = 1 << 19


def _signals(t: Tables):
    """Demand with the stock and receipts of its replay under the service-level policy."""
    lines = c.lines(t, "l_suppkey")
    axis = dm.read_axis(lines)
    items = rp.policy_items(lines, axis, None, ["service-level"], rp.Costs())
    # so many items to a task as have about TASK_ROWS days
    parts = max(t.spark.sparkContext.defaultParallelism, items.count() * axis.days // TASK_ROWS)
    items = items.repartition(parts, "sku_id")
    return rp.packed_replay(items, axis)


def _plain_signals(t: Tables):
    """Signals SQL can derive: demand, the day before's demand as receipts, cumulative demand mod 50 as stock."""
    dense = dm.dense(*_panel(t))
    return dense.select("sku_id", "day", "i", F.col("qty").alias("demand"), (F.pmod(F.col("i"), F.lit(5)) * 10.0).alias("receipts"),
                        (F.pmod(F.col("i") * 7, F.lit(50)) + F.col("qty")).alias("on_hand"))


SIGNAL_SQL = """signals as materialized (select sku_id, day, i, qty as demand, cast((i % 5) * 10 as double) as receipts, cast((i * 7) % 50 + qty as double) as on_hand from dense)"""


@query("e06_rolling_median", with_sql(*SUPPLIERS) + """select a.sku_id, a.i, median(b.qty) as rolling from dense a cross join (select unnest(generate_series(-3, 3)) as o) cross join axis x
  join dense b on b.sku_id = a.sku_id and b.i = least(greatest(a.i + o, 0), x.n - 1) group by 1, 2""")
def _(t: Tables):
    return rounded(_plain_signals(t).select("sku_id", "i", de.rolling_median("demand").alias("rolling")))


@query("e07_weekday_median", with_sql(*SUPPLIERS) + """select sku_id, i, m as weekday_median from dense join (select sku_id as s, isodow(day) as w, median(qty) as m from dense group by 1, 2)
  on s = sku_id and w = isodow(day)""")
def _(t: Tables):
    return rounded(de.weekday_median(_plain_signals(t).select("sku_id", "day", "i", "demand"), "demand", together=True).select("sku_id", "i", "weekday_median"))


@query("e08_stock_balance", with_sql(*SUPPLIERS, SIGNAL_SQL) + """select sku_id, i, case when g is null or abs(g) < 1e-6 then 0 else g end as balance from (select sku_id, i,
  on_hand - lag(on_hand) over (partition by sku_id order by i) - receipts + demand as g from signals)""")
def _(t: Tables):
    return rounded(de.stock_balance(_plain_signals(t).drop("day"), together=True).select("sku_id", "i", "balance"))


FEATURES_SQL = """roll as materialized (select a.sku_id, a.i, median(b.qty) as rolling from dense a cross join (select unnest(generate_series(-3, 3)) as o) cross join axis x
  join dense b on b.sku_id = a.sku_id and b.i = least(greatest(a.i + o, 0), x.n - 1) group by 1, 2),
wd as (select sku_id, isodow(day) as w, median(qty) as m from dense group by 1, 2),
item as (select sku_id, greatest(stddev_pop(qty), 1) as s, median(qty) as med, greatest(avg(qty), 1e-9) as mean from dense group by 1),
gaps as (select sku_id, i, on_hand - lag(on_hand) over (partition by sku_id order by i) - receipts + demand as g from signals)"""


@query("k04_features", with_sql(*SUPPLIERS, SIGNAL_SQL, FEATURES_SQL) + """select d.sku_id, cast(d.day as varchar) as day, d.i, d.demand, round((demand - med) / s, 6) + 0 as level,
  round((demand - wd.m) / s, 6) + 0 as weekday, round((demand - rolling) / s, 6) + 0 as rolling, cast(demand = 0 as int)::double as is_zero,
  round(least(case when g is null or abs(g) < 1e-6 then 0 else g end, 0) / mean, 6) + 0 as missing
  from signals d join item on item.sku_id = d.sku_id join wd on wd.sku_id = d.sku_id and w = isodow(d.day) join roll on roll.sku_id = d.sku_id and roll.i = d.i
  join gaps on gaps.sku_id = d.sku_id and gaps.i = d.i""")
def _(t: Tables):
    return rounded(de.signal_features(_plain_signals(t), together=True))


@query("k04_isolation_forest")
def _(t: Tables):
    found = de.isolation_forest(_signals(t))[1]
    return rounded(found.withColumn("reasons", F.array_join("reasons", ",")))


@query("k07_injected_anomalies")
def _(t: Tables):
    return rounded(de.inject(_signals(t)).rows(lambda table: table.column("kind").is_valid().to_numpy()).select(
        "sku_id", "day", "i", "receipts", "demand", "on_hand", "kind"))


@query("k08_detector_benchmark")
def _(t: Tables):
    panel = de.inject(_signals(t))
    return rounded(de.score_detectors(panel, {"seasonal-residual": de.seasonal_detector, "isolation-forest": de.isolation_forest}))


PLACES_SQL = """flagged as (select key as sku_id, i from scored where abs(robust_z) >= 3.5),
injected as (select sku_id, i, ['spike','drop','shrinkage'][cast(i % 3 as int) + 1] as kind from dense where (i * 31 + cast(sku_id as bigint) * 17) % 97 = 0),
both_sides as (select coalesce(f.sku_id, j.sku_id) as sku_id, coalesce(f.i, j.i) as i, kind, f.i is not null as flagged, j.i is not null as injected
  from flagged f full join injected j on f.sku_id = j.sku_id and f.i = j.i)"""
PLACES = [*SUPPLIERS, SERIES_SQL, RESIDUAL_SQL, PLACES_SQL]


def _places(t: Tables):
    panel = dm.dense(*_panel(t)).select("sku_id", "day", "i", F.col("qty").alias("demand"))
    found = de.seasonal_detector(panel, together=True)[1]
    kinds = F.array(*[F.lit(k) for k in de.KINDS])
    injected = panel.where((F.col("i") * 31 + F.col("sku_id").cast("bigint") * 17) % 97 == 0).select(
        "sku_id", "day", "i", F.element_at(kinds, (F.col("i") % 3 + 1).cast("int")).alias("kind"))
    return found, injected


@query("c10_flagged_and_injected", with_sql(*PLACES) + "select coalesce(kind, 'none') as kind, flagged, injected, count(*) as n from both_sides group by 1, 2, 3")
def _(t: Tables):
    return de.match(*_places(t)).groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "flagged", "injected").agg(F.count(F.lit(1)).alias("n"))


@query("d28_detection_scores", with_sql(*PLACES, """false_alarms as (select count(*) as n from both_sides where flagged and not injected),
  counts as (select kind, count(*) filter (flagged) as hits, count(*) as places from both_sides where injected group by 1
  union all select 'all', count(*) filter (flagged), count(*) from both_sides where injected)""") + """select kind, round(hits / (hits + n), 6) as precision, round(hits / places, 6) as recall,
  round(coalesce(2.0::double * (hits / (hits + n)) * (hits / places) / nullif(hits / (hits + n) + hits / places, 0), 0), 6) as f1, hits + n as flagged, hits, places from counts cross join false_alarms""")
def _(t: Tables):
    return rounded(de.detection_scores(*_places(t)))


@query("g04_hits_and_false_alarms", with_sql(*PLACES) + """select 'hit' as side, count(*) as n from (select sku_id, i from flagged intersect select sku_id, i from injected)
  union all select 'false alarm', count(*) from (select sku_id, i from flagged except select sku_id, i from injected)""")
def _(t: Tables):
    found, injected = (x.select("sku_id", "i") for x in _places(t))
    hit = found.intersect(injected).agg(F.count(F.lit(1)).alias("n")).select(F.lit("hit").alias("side"), "n")
    return hit.unionByName(found.subtract(injected).agg(F.count(F.lit(1)).alias("n")).select(F.lit("false alarm").alias("side"), "n"))


@query("f04_top_k", with_sql(*SUPPLIERS, SERIES_SQL, RESIDUAL_SQL) + """select key as sku_id, i, round(abs(robust_z), 6) as score from scored order by abs(robust_z) desc, sku_id, i
  limit (select cast(round(count(*) / 100) as bigint) from dense)""")
def _(t: Tables):
    panel = dm.dense(*_panel(t)).select("sku_id", "day", "i", F.col("qty").alias("demand"))
    scores = de.seasonal_detector(panel, together=True)[0]
    return rounded(de.top_k(scores, round(panel.count() / 100)).select("sku_id", "i", "score"))


@query("f07_detections_in_order", with_sql(*SUPPLIERS, SERIES_SQL, RESIDUAL_SQL) + """select key as sku_id, i, round(abs(robust_z), 2) as score,
  case when robust_z > 0 then 'spike' else 'drop' end as direction from scored where abs(robust_z) >= 3.5 order by 3 desc, 1, 2""")
def _(t: Tables):
    return de.in_order(_places(t)[0]).select("sku_id", "i", "score", "direction")


@query("b12_detection_guard", "select 0::bigint as missing_scores, 0::bigint as bad_scores, 0::bigint as outside, 0::bigint as bad_detections, 0::bigint as bad_directions")
def _(t: Tables):
    panel = dm.dense(*_panel(t)).select("sku_id", "day", "i", F.col("qty").alias("demand"))
    return de.guard(*de.seasonal_detector(panel, together=True), panel)


def _threshold(panel):
    """A user's own detector: demand above ten times the item's mean."""
    from pyspark.sql import Window

    mean = F.avg("demand").over(Window.partitionBy("sku_id"))
    scores = panel.select("sku_id", "day", "i", (F.col("demand") / F.greatest(mean, F.lit(1e-9))).alias("score"))
    found = scores.where(F.col("score") > 10).withColumns({"direction": F.lit("spike"), "reasons": F.array(F.lit("demand"))})
    return scores, found


@query("u02_own_detector", with_sql(*SUPPLIERS, "means as (select sku_id, avg(qty) as m from dense group by 1)") + """select d.sku_id, i, round(qty / m, 6) as score, 'spike' as direction
  from dense d join means on means.sku_id = d.sku_id where qty / m > 10""")
def _(t: Tables):
    panel = dm.dense(*_panel(t)).select("sku_id", "day", "i", F.col("qty").alias("demand"))
    return rounded(_threshold(panel)[1].select("sku_id", "i", "score", "direction"))


# --- boosted forecasts -------------------------------------------------------------------------------


@query("e04_boosting_features", with_sql(*SUPPLIERS) + """select sku_id, i, round(l1, 6) as last_1, l7 as last_7, l14 as last_14, round(m7, 6) as mean_7, round(m28, 6) as mean_28, round(z28, 6) as zero_share_28,
  cast((isodow(day) - 1 + k - 1) % 7 as bigint) as weekday, k as days_ahead, case when i + k - 1 < n then lead(qty, 0) over () end is not null as has_target from (
  select sku_id, i, day, qty, lag(qty, 1) over w as l1, lag(qty, 7) over w as l7, lag(qty, 14) over w as l14,
  avg(qty) over (partition by sku_id order by i rows between 7 preceding and 1 preceding) as m7, avg(qty) over (partition by sku_id order by i rows between 28 preceding and 1 preceding) as m28,
  avg(case when qty = 0 then 1.0::double else 0 end) over (partition by sku_id order by i rows between 28 preceding and 1 preceding) as z28 from dense window w as (partition by sku_id order by i))
  cross join axis cross join (select unnest([1, 7]) as k) where i >= 28""")
def _(t: Tables):
    panel, axis = _panel(t)
    # rounded before a row is spread to its days ahead
    rows = bo.feature_rows(panel, axis, 7, [1, 7], lambda f: f.where(F.col("i") < axis.days).withColumns({n: r(n) + F.lit(0.0) for n in bo.FEATURES[:6]}))
    return rows.select("sku_id", "i", *bo.FEATURES[:6], *[F.col(n).cast("bigint").alias(n) for n in bo.FEATURES[6:]], F.col("target").isNotNull().alias("has_target"))


@query("i09_gradient_boosting")
def _(t: Tables):
    panel, axis = _panel(t)
    at = fc.origins_of(axis, H, ORIGINS, STEP)
    return rounded(bo.boosted_forecasts(panel, axis, at, H, LEVELS, trees=30, rate=0.2, max_rows=60_000), 4)
