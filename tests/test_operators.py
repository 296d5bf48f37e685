"""Hand-traced, closed-form and brute-force checks of the operators."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockwright.functions import numeric as nm, ranks
from stockwright.operators import (boosting as bo, causal as ca, demand as dm, detect as de, fidelity as fi, forecast as fc, kpi, metrics,
                                   pivot as pv, replenish as rp, series as se, studies as st, synth as sy, trees as tr, utility as ut)

DAY0 = date(2024, 1, 1)


def panel_of(spark, series):
    rows = [(k, DAY0 + timedelta(days=i), float(q)) for k, qs in series.items() for i, q in enumerate(qs) if q]
    return spark.createDataFrame(rows, "sku_id string, day date, qty double")


def axis_of(n):
    return dm.Axis(DAY0, DAY0 + timedelta(days=n - 1), n)


# --- numbers ---------------------------------------------------------------------------------------


def test_special_functions_match_tables():
    assert nm.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert nm.t_quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-4)
    assert nm.t_quantile(0.95, 120) == pytest.approx(1.657651, abs=1e-5)
    assert nm.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_draws_do_not_depend_on_partitioning_and_have_the_right_moments(spark):
    df = spark.range(20000)
    u = nm.uniform(5, "t", "id")
    one = df.repartition(1).select("id", u.alias("u")).orderBy("id").toPandas()
    many = df.repartition(8).select("id", u.alias("u")).orderBy("id").toPandas()
    assert (one.u == many.u).all() and abs(one.u.mean() - 0.5) < 0.01
    row = df.select(nm.normal(5, "n", "id").alias("z"), nm.poisson(F.lit(3.0), nm.uniform(5, "p", "id")).alias("k")).agg(
        F.avg("z").alias("m"), F.stddev("z").alias("s"), F.avg("k").alias("k"), F.var_samp("k").alias("v")).first()
    assert abs(row.m) < 0.03 and abs(row.s - 1) < 0.03 and abs(row.k - 3) < 0.05 and abs(row.v - 3) < 0.15


def test_quantiles_are_exact_with_one_value_owning_most_rows(spark):
    rng = np.random.default_rng(0)
    hot = np.concatenate([np.full(5000, 7.0), rng.normal(0, 10, 3000)])
    rows = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in range(5)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in ranks.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.977}).collect()}
    assert [got["hot"][x] for x in "abc"] == pytest.approx(list(np.quantile(hot, [0.1, 0.5, 0.977])))
    assert got["cold"].b == 2.0 and got[None].b == 1.0


def test_largest_and_ranks(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)], "i int, v double")
    top = ranks.largest(df, "v", 15, ["i"]).collect()
    assert sorted(r.i for r in top) == sorted([i for i in range(100) if i % 10 == 9] + [8, 18, 28, 38, 48])
    pool = spark.createDataFrame([("a", 1.0, 0, 90), ("a", 2.0, 90, 10)], "k string, v double, before bigint, n bigint")
    draws = spark.createDataFrame([("a", r) for r in (0, 89, 90, 99)], "k string, r bigint")
    found = {r.r: r.v for r in ranks.values_at_ranks(draws, pool, ["k"], "r", "v", "before", "n", width=7).collect()}
    assert found == {0: 1.0, 89: 1.0, 90: 2.0, 99: 2.0}


# --- demand and replenishment ------------------------------------------------------------------------


def test_profile_equals_the_dense_definition(spark):
    series = {"a": [0, 0, 5, 0, 3, 0, 0, 9], "b": [1, 2, 3, 4, 5, 6, 7, 8]}
    rows = {r.sku_id: r for r in dm.profiles(panel_of(spark, series), 8).collect()}
    for k, y in series.items():
        y = np.array(y, float)
        assert rows[k].mean == pytest.approx(y.mean()) and rows[k].std == pytest.approx(y.std()) and rows[k].zero_ratio == pytest.approx((y == 0).mean())
    assert rows["a"].intermittent and rows["a"].variability == pytest.approx(max(np.std(series["a"]), 17 / 8 / (3 / 8)))
    assert rows["b"].variability == pytest.approx(rows["b"].std)


def test_dense_and_slices(spark):
    panel, axis = panel_of(spark, {"a": [0, 2, 0, 0, 1, 0]}), axis_of(6)
    got = [r.qty for r in dm.dense(panel, axis).orderBy("i").collect()]
    assert got == [0, 2, 0, 0, 1, 0]
    assert dm.until(panel, DAY0 + timedelta(days=2)).count() == 1
    with pytest.raises(ValueError, match="of 9 days"):
        dm.window(panel, axis, DAY0, 9)
    with pytest.raises(ValueError, match="lies outside"):
        dm.window(panel, axis, date(2020, 1, 1), 2)


def items_of(spark, series, s, big_s):
    axis = axis_of(len(next(iter(series.values()))))
    packed = dm.series(panel_of(spark, series), axis)
    return packed.withColumns({"policy": F.lit("p"), "reorder_point": F.lit(float(s)), "order_up_to": F.lit(float(big_s))}), axis


def test_hand_traced_replay(spark):
    # S = 10, s = 4, lead time 2: day 0 serve 6 -> 4 left, order 6 for day 2; day 1 wants 6, serves 4, loses 2, position 6;
    # day 2 receive 6, serve 1 -> 5, position 5; day 3 serve 1 -> 4, order 6 for day 5; day 4 serve 4 -> 0; day 5 receive 6
    items, axis = items_of(spark, {"a": [6, 6, 1, 1, 4, 0]}, 4, 10)
    want = (2.0, 4.0 + 0 + 5 + 4 + 0 + 6, 2, 18.0)
    for form in (rp.replay, rp.replay_by_expression):
        row = form(items, axis.days, 2).first()
        assert (row.unmet_units, row.holding_unit_days, row.n_orders, row.total_demand) == want
    daily = rp.daily_replay(items, axis, 2).orderBy("day").collect()
    assert [r.on_hand for r in daily] == [4, 0, 5, 4, 0, 6] and [r.receipts for r in daily] == [0, 0, 6, 0, 0, 6]


def test_both_replay_forms_agree(spark):
    rng = np.random.default_rng(1)
    series = {f"k{j}": (rng.poisson(0.8, 120) * rng.integers(1, 6, 120)).tolist() for j in range(12)}
    items, axis = items_of(spark, series, 9.5, 21.25)
    a = rp.replay(items, axis.days).orderBy("sku_id").collect()
    b = rp.replay_by_expression(items, axis.days).orderBy("sku_id").collect()
    assert a == b


def test_cost_based_levels_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    y = (rng.poisson(0.5, 90) * 4.0)
    panel, axis, costs = panel_of(spark, {"a": y}), axis_of(90), rp.Costs()
    base = rp.with_prices(dm.profiles(panel, 90).join(dm.series(panel, axis), "sku_id"), None)
    got = rp.cost_based_levels(base, 90, costs).first()
    p = dm.profiles(panel, 90).first()
    lot = min(math.sqrt(2 * 25 * p.mean / (0.25 / 313)), p.mean * 90)
    best = None
    for z in rp.Z_GRID:
        for m in rp.LOT_GRID:
            s = p.mean * 14 + z * p.variability * math.sqrt(14)
            u, h, o, _, _ = rp.fold(y[None, :], np.array([s]), np.array([s + m * lot]), 7)
            cost = h[0] * 0.25 / 313 + o[0] * 25 + u[0] * 0.3
            if best is None or cost < best[0] - 1e-12:
                best = (cost, s, s + m * lot)
    assert (got.least_cost, got.reorder_point, got.order_up_to) == pytest.approx(best)


def test_plan_rounds_half_even_and_orders_only_when_low(spark):
    levels = spark.createDataFrame([("a", 1.0, 10.5, 0.0, False), ("b", 1.0, 4.0, 0.0, False)], "sku_id string, mean double, order_up_to double, safety_stock double, intermittent boolean")
    levels = levels.withColumn("reorder_point", F.col("order_up_to"))
    stock = spark.createDataFrame([("b", "x", 9, 1)], "sku_id string, location_id string, on_hand int, reserved int")
    got = {r.sku_id: r.order_qty for r in rp.plan(levels, stock).collect()}
    assert got == {"a": 10, "b": 0}
    with pytest.raises(ValueError, match="holding_rate"):
        rp.Costs(holding_rate=2.0)
    assert rp.z_of(0.96) == 1.645


# --- pivot -------------------------------------------------------------------------------------------


def test_pivot_totals_come_from_rows_and_null_is_not_zero(spark):
    df = spark.createDataFrame([("a", "x", 1.0, "p"), ("a", "y", 3.0, "p"), ("b", "x", None, "q"), (None, "x", 8.0, None)], "r string, c string, v double, k string")
    view = pv.View(rows=["r"], columns=["c"], values=[("v", "mean"), ("k", "count_distinct"), ("v", "median"), ("v", "sum")])
    got = {(r.depth, r.cell, r.r1, r.c1): r for r in pv.pivot(df, view).collect()}
    assert got[0, False, None, None].v1 == 4.0 and got[0, False, None, None].v2 == 2.0 and got[0, False, None, None].v3 == 3.0
    assert got[1, True, "b", "x"].v4 is None and (1, True, "b", "y") not in got
    assert got[1, False, None, None].v4 == 8.0  # the blank label is not the total
    share = {(r.depth, r.cell, r.r1, r.c1): r.v1 for r in pv.pivot(df, pv.View(rows=["r"], columns=["c"], values=[("v", "sum")], show_as="share_of_row")).collect()}
    assert share[1, True, "a", "x"] == 0.25 and share[1, True, "b", "x"] is None


def test_pivot_folds_and_orders(spark):
    df = spark.createDataFrame([(f"item{i}", f"c{j}", float(10 * j - 35)) for i in (1, 2, 10) for j in range(6)], "r string, c string, v double")
    got = pv.pivot(df, pv.View(rows=["r"], columns=["c"], values=[("v", "sum")], max_columns=3))
    labels = {r.c1 for r in got.where("cell").collect()}
    assert labels == {"c0", "c1", "Other"}  # totals -105, -75, -45, -15, 15, 45
    assert got.where("cell and depth = 0 and c1 = 'Other'").first().v1 == 0.0
    order = [r.r1 for r in pv.ordered(got, 1).where("depth = 1").collect()]
    assert order == ["item1", "item2", "item10"]
    with pytest.raises(ValueError, match="one list"):
        pv.pivot(df, pv.View(filters={"r": {"include": [], "exclude": []}}))
    with pytest.raises(ValueError, match="takes numbers"):
        pv.pivot(df, pv.View(values=[("r", "sum")]))
    with pytest.raises(ValueError, match="no grain"):
        pv.pivot(df, pv.View(rows=[("r", "month")]))
    blank = pv.apply_filters(spark.createDataFrame([("a",), (None,)], "r string"), {"r": {"exclude": [None]}})
    assert [x.r for x in blank.collect()] == ["a"]


# --- series and forecasts ------------------------------------------------------------------------------


def test_one_step_models_and_short_series(spark):
    y = [3.0, 0.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(y)] + [("s", 0, 1.0), ("s", 1, 2.0)], "key string, i bigint, value double")
    rows = [r for r in se.one_step(df, 7).orderBy("key", "i").collect() if r.key == "k"]
    for t, r in enumerate(rows):
        h = y[:t]
        assert r["mean"] == pytest.approx(np.mean(h) if h else 0) and r.ma7 == pytest.approx(np.mean(h[-7:]) if h else 0)
        assert r.snaive7 == (h[-7] if len(h) >= 7 else (h[-1] if h else 0)) and r.naive == (h[-1] if h else 0)
    ranked = se.compare_models(df, 7).collect()
    assert {r.key for r in ranked} == {"k"} and len(ranked) == 5  # a series under three points has no row


def test_residual_scale_rules(spark):
    def method(values):
        df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "key string, i bigint, value double")
        return se.residual_scales(df, 2).first()
    assert method([0] * 20).method == "floor"
    assert method([0] * 18 + [50, 50]).method == "mean_abs_dev"
    assert method(list(range(0, 60, 3))).method == "mad"
    short = spark.createDataFrame([("k", i, 1.0) for i in range(7)], "key string, i bigint, value double")
    assert se.seasonal_residuals(short, 7).count() == 0


def reference_forecast(y, horizon, levels, period=7, window=7):
    """Brute force of the interval rule for the four point models."""
    n, out = len(y), {}
    def path(name, o):
        h = y[:o]
        if name == "mean": return [h.mean()] * horizon
        if name == "naive": return [h[-1]] * horizon
        if name == "moving-average": return [h[-window:].mean()] * horizon
        return [h[o - period + k % period] if o >= period else h[-1] for k in range(horizon)]
    for name in fc.POINT_MODELS:
        point = path(name, n)
        for k in range(horizon):
            errors = [y[o + k] - path(name, o)[k] for o in range(max(1, n - 56), n) if o + k < n]
            for lv in levels:
                offset = np.quantile(errors, lv) if len(errors) >= 14 else None
                out[name, k, lv] = (max(point[k], 0), max(point[k] + offset, 0) if offset is not None else None)
    return out


def test_forecast_beyond_the_data_equals_brute_force(spark):
    y = np.random.default_rng(3).poisson(2.0, 80).astype(float)
    panel, axis = panel_of(spark, {"a": y}), axis_of(80)
    want = reference_forecast(y, 10, [0.1, 0.9])
    rows = fc.forecasts(panel, axis, [80], 10, [0.1, 0.9]).collect()
    assert len(rows) == 40
    for r in rows:
        for lv, name in ((0.1, "q10"), (0.9, "q90")):
            mean, q = want[r.forecaster, r.k, lv]
            assert r["mean"] == pytest.approx(mean) and r[name] == pytest.approx(q)
        assert r.actual is None


def test_no_forecast_sees_its_origin(spark):
    y = np.random.default_rng(4).poisson(2.0, 90).astype(float)
    other = y.copy()
    other[70:] = 50.0
    models = [*fc.POINT_MODELS, "seasonal-linear"]
    a, b = (fc.forecasts(panel_of(spark, {"a": v}), axis_of(90), [70], 7, [0.1, 0.9], models).drop("actual").orderBy("forecaster", "k").collect() for v in (y, other))
    assert a == b


def test_few_errors_are_pooled_over_items(spark):
    rng = np.random.default_rng(5)
    y = {k: rng.poisson(3.0, 20).astype(float) + 1 for k in "abc"}
    panel, axis = panel_of(spark, y), axis_of(20)
    rows = fc.forecasts(panel, axis, [20], 12, [0.1, 0.9], ["naive"]).where("k = 10").collect()
    scaled = [(v[o + 10] - v[o - 1]) / v.mean() for v in y.values() for o in range(1, 20) if o + 10 < 20]
    for r in rows:
        v = y[r.sku_id]
        assert r.q90 == pytest.approx(max(0, v[-1] + np.quantile(scaled, 0.9) * v.mean()))


def test_seasonal_linear_finds_a_cycle(spark):
    y = np.array([5 + 3 * (i % 7 == 2) + 0.1 * i for i in range(84)])
    rows = fc.forecasts(panel_of(spark, {"a": y}), axis_of(84), [84], 7, [0.1, 0.9], ["seasonal-linear"]).orderBy("k").collect()
    assert [r["mean"] for r in rows] == pytest.approx([5 + 3 * (i % 7 == 2) + 0.1 * i for i in range(84, 91)], abs=0.05)


def test_backtest_scores_by_hand(spark):
    rows = [("f", 0, 1.0, 2.0, 0.0, 3.0), ("f", 1, 3.0, 2.0, 0.0, 2.5), ("seasonal-naive", 0, 1.0, 3.0, 1.0, 4.0), ("seasonal-naive", 1, 3.0, 3.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "forecaster string, k int, actual double, mean double, q10 double, q90 double")
    r = metrics.forecast_scores(df, [0.1, 0.9]).where("forecaster = 'f' and days_ahead = 0").first()
    pin = np.mean([np.mean([0.1 * 1, 0.9 * 0 + 0.1 * 2]), np.mean([0.1 * 3, 0.9 * 0.5])])
    assert (r.wape, r.relative, r.bias, r.mae) == pytest.approx((0.5, 1.0, 0.0, 1.0))
    assert r.pinball == pytest.approx(pin) and r.coverage_open == 0.5 and r.coverage_closed == 0.5 and r.width == 2.75
    assert metrics.quantile_name(0.025) == "q2_5"
    with pytest.raises(ValueError, match="are needed"):
        fc.origins_of(axis_of(40), 14, 4, 7)


def test_boosted_forecast_beats_seasonal_naive_on_its_own_ground(spark):
    rng = np.random.default_rng(6)
    week = np.array([1, 1, 2, 2, 6, 8, 1])
    y = {f"k{j}": rng.poisson(week[np.arange(140) % 7] * (1 + j % 3)).astype(float) for j in range(12)}
    panel, axis = panel_of(spark, y), axis_of(140)
    at = fc.origins_of(axis, 7, 1, 7)
    scores, _ = fc.backtest(panel, axis, 7, 1, 7, [0.1, 0.9], more=bo.boosted_forecasts(panel, axis, at, 7, [0.1, 0.9], trees=12, rate=0.3))
    got = {r.forecaster: r for r in scores.where("days_ahead = 0").collect()}
    assert got["gradient-boosting"].relative < 0.9 and got["gradient-boosting"].pinball < 0.9 * got["seasonal-naive"].pinball


def test_boosted_forecast_reads_nothing_from_an_origin_on(spark):
    rng = np.random.default_rng(2)
    y = {f"k{j}": rng.poisson(3 + j, 90).astype(float) for j in range(6)} | {"young": np.r_[np.zeros(70), rng.poisson(5, 20)]}
    later = {k: np.r_[v[:76], v[76:] * 7 + 1] for k, v in y.items()}
    one, other = ({(r.sku_id, r.k): (r.mean, r.q10, r.q90) for r in bo.boosted_forecasts(panel_of(spark, s), axis_of(90), [76, 83], 7, [0.9, 0.1], trees=4, rate=0.3).where("origin = 76").collect()}
                  for s in (y, later))
    assert one == other and len(one) == 7 * len(y)
    assert all(0 <= low <= high for _, low, high in one.values())
    held = fc.forecasts(panel_of(spark, y), axis_of(90), [76], 7, [0.1, 0.9], ["moving-average"]).where("sku_id = 'young' and k = 0").first()
    assert one["young", 0] == pytest.approx((held.mean, held.q10, held.q90))
    nothing = bo.boosted_forecasts(panel_of(spark, {"b": np.r_[np.zeros(80), np.ones(10)]}), axis_of(90), [76], 7, [0.5], trees=2).collect()
    assert len(nothing) == 7 and all(r.mean == 0 for r in nothing)


def test_first_tree_against_every_split(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (3000, 2)).astype(float)
    y = np.round(5 + 4 * (x[:, 0] > 2) * x[:, 1] + rng.normal(0, 1, 3000), 2)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    model = tr.fit(df, ["a", "b"], "y", [tr.Spec(None), tr.Spec(0.8)], trees=1, rate=1.0, depth=1)
    for m, level in enumerate((None, 0.8)):
        start = model.trees[m][0].leaf[0]
        assert start == pytest.approx(np.log(y.mean()) if level is None else np.quantile(y, level), rel=0.03)
        g, h = (y - np.exp(start), np.full(len(y), np.exp(start))) if level is None else tr._slopes(level, y, np.full(len(y), start), y.max() * tr.FINEST)
        gain = {(f, b): sum(g[s].sum() ** 2 / h[s].sum() for s in (x[:, f] <= b, x[:, f] > b)) for f in (0, 1) for b in range(5)}
        f, b = max(gain, key=gain.get)
        tree = model.trees[m][1]
        assert tree.feature == [f] and (tr.binned(x, model.borders)[f] <= tree.bin[0]).tolist() == (x[:, f] <= b).tolist()
        for leaf, side in zip(tree.leaf, (x[:, f] <= b, x[:, f] > b)):
            want = np.clip(g[side].sum() / h[side].sum(), -2, 2) if level is None else np.quantile(y[side] - start, level, method="inverted_cdf")
            assert leaf == pytest.approx(want, rel=0.03, abs=0.01)
    with pytest.raises(ValueError, match="negative"):
        tr.fit(df.withColumn("y", -F.col("y")), ["a", "b"], "y", [tr.Spec(None)])


def test_trees_fit_quantiles_under_any_partitioning(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 8, (6000, 2)).astype(float)
    y = rng.poisson(1 + x[:, 0] * (x[:, 1] > 4)).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t), i % 3) for i, ((a, b), t) in enumerate(zip(x, y))], "a double, b double, y double, w int")
    specs = [tr.Spec(0.1, 2), tr.Spec(0.5, 2), tr.Spec(0.9, 2), tr.Spec(0.9, 0)]
    one, other = (tr.fit(d, ["a", "b"], "y", specs, "w", trees=8, rate=0.5, depth=3).predicted(x, range(4)) for d in (df, df.repartition(5)))
    assert np.abs(one - other).max() < 1e-9
    pinball = lambda q, f: np.mean(np.maximum(q * (y - f), (q - 1) * (y - f)))
    cell = x[:, 0] * 10 + x[:, 1]
    for i, q in enumerate((0.1, 0.5, 0.9)):
        best = np.zeros(len(y))
        for c in np.unique(cell):
            best[cell == c] = np.quantile(y[cell == c], q, method="inverted_cdf")
        assert pinball(q, one[i]) < 1.08 * pinball(q, best)
    assert pinball(0.9, one[3]) < 0.6 * pinball(0.9, np.quantile(y, 0.9))


# --- detectors -----------------------------------------------------------------------------------------


def signal_panel(spark, n_items=20, days=120, seed=7):
    rng = np.random.default_rng(seed)
    y = {f"k{j:02d}": rng.poisson(6.0, days).astype(float) for j in range(n_items)}
    panel, axis = panel_of(spark, y), axis_of(days)
    items = rp.service_levels(dm.profiles(panel, days)).join(dm.series(panel, axis), "sku_id")
    return rp.daily_replay(items, axis).withColumn("i", F.datediff("day", F.lit(DAY0)).cast("bigint"))


def test_injection_and_detection(spark):
    panel = de.inject(signal_panel(spark), 0.01, seed=3).cache()
    places = panel.where("kind is not null")
    assert places.count() == round(0.01 * 20 * 120) and panel.agg(F.min("on_hand")).first()[0] >= -1e-9
    again = de.inject(signal_panel(spark).repartition(3), 0.01, seed=3).where("kind is not null")
    assert {(r.sku_id, r.i, r.kind) for r in places.collect()} == {(r.sku_id, r.i, r.kind) for r in again.collect()}
    # away from shrinkage the balance still holds
    gaps = de.signal_features(panel.drop("kind")).where("abs(missing) > 1e-6").select("sku_id", "i")
    kinds = {r.kind for r in places.join(gaps, ["sku_id", "i"]).collect()}
    assert kinds <= {"shrinkage"}
    scores = de.score_detectors(panel, {"isolation-forest": lambda p: de.isolation_forest(p, trees=60), "broken": broken})
    got = {(r.detector, r.cut, r.kind): r for r in scores.collect()}
    assert got["isolation-forest", "threshold", "shrinkage"].recall >= 0.8
    assert got["broken", "threshold", "all"].error == "no answer"


def broken(panel):
    raise ValueError("no answer")


def test_detection_scores_by_hand(spark):
    flagged = spark.createDataFrame([("a", DAY0), ("b", DAY0), ("c", DAY0)], "sku_id string, day date")
    injected = spark.createDataFrame([("a", DAY0, "spike"), ("d", DAY0, "spike"), ("b", DAY0, "drop")], "sku_id string, day date, kind string")
    got = {r.kind: r for r in de.detection_scores(flagged, injected).collect()}
    assert (got["spike"].precision, got["spike"].recall) == (0.5, 0.5) and got["drop"].recall == 1.0
    assert got["all"].precision == pytest.approx(2 / 3) and got["all"].flagged == 3


# --- causal ----------------------------------------------------------------------------------------------


def causal_table(spark, n=4000, effect=2.0, seed=8):
    rng = np.random.default_rng(seed)
    x, g = rng.normal(size=n), rng.choice(["u", "v", "w"], n)
    t = (rng.random(n) < 1 / (1 + np.exp(0.3 - x))).astype(int)
    y = 1 + effect * t + 1.5 * x + (g == "v") * 0.7 + rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "t": t, "y": y, "x": x, "g": g})), t, y, x, g


def test_estimators_against_numpy_and_the_truth(spark):
    df, t, y, x, g = causal_table(spark)
    q = ca.Question("t", "y", ("x", "g"))
    d = ca.design(df, q, ("id",))
    X = np.column_stack([np.ones(len(t)), t, x, g == "v", g == "w"]).astype(float)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    e, inv = y - X @ beta, np.linalg.inv(X.T @ X)
    cov = inv @ (X.T * e**2) @ X @ inv * len(t) / (len(t) - 5)
    est = ca.regression_adjustment(d)
    assert est[1] == pytest.approx(beta[1]) and est[4] == pytest.approx(math.sqrt(cov[1, 1])) and est[2] < 2.0 < est[3]
    naive = ca.difference_in_means(d)
    assert naive[1] == pytest.approx(y[t == 1].mean() - y[t == 0].mean()) and not naive[2] < 2.0 < naive[3]
    weighted = ca.ipw(d, ("id",), bootstrap=60)
    assert weighted[2] < 2.0 < weighted[3] and abs(weighted[1] - 2.0) < 0.2
    other = ca.ipw(ca.design(df.repartition(5), q, ("id",)), ("id",), bootstrap=60)
    assert other[1:4] == pytest.approx(weighted[1:4])


def test_causal_refusals(spark):
    df, *_ = causal_table(spark, 400)
    twice = df.withColumns({"x2": F.col("x") * 2, "five": F.lit(5.0)})
    for extra in ("x2", "five"):
        rows = ca.score_estimators(twice, ca.Question("t", "y", ("x", extra)), ("id",), names=("regression-adjustment",)).collect()
        assert "not identified" in rows[0].error
    for q, text in ((ca.Question("t", "t"), "one role"), (ca.Question("t", "y", ("y",)), "one role"), (ca.Question("x", "y"), "must be 0 or 1"),
                    (ca.Question("t", "y", ("nope",)), "no such column")):
        with pytest.raises(ValueError, match=text):
            ca.design(df, q)
    split = df.withColumn("sure", F.col("t") * 10.0 + F.col("x") / 100)
    assert "hardly overlap" in ca.score_estimators(split, ca.Question("t", "y", ("sure",)), ("id",), names=("ipw",)).first().error


def test_paired_effects_by_hand(spark):
    rows = [(r, a, "p", "m", v) for r, (b, x) in enumerate([(1.0, 3.0), (2.0, 5.0), (3.0, 4.0)]) for a, v in (("baseline", b), ("arm", x))]
    df = spark.createDataFrame(rows, "replicate int, arm string, policy string, metric string, value double")
    r = st.paired_effects(df, 3).first()
    diffs = [2.0, 3.0, 1.0]
    half = 4.302653 * np.std(diffs, ddof=1) / math.sqrt(3)
    assert (r.effect, r.low, r.relative) == pytest.approx((2.0, 2.0 - half, 1.0), abs=1e-5)


# --- synthesis ----------------------------------------------------------------------------------


def brute_nearest(q, p):
    d = np.sqrt(((q[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
    return np.sort(d, axis=1)[:, :2]


def test_nearest_rows_equal_brute_force_on_clustered_data(spark):
    rng = np.random.default_rng(9)
    real = np.concatenate([rng.normal(0.2, 0.001, (1500, 3)), rng.random((60, 3)), np.tile([[0.7, 0.7, 0.7]], (800, 1))])
    fake = np.concatenate([rng.normal(0.2, 0.01, (200, 3)), rng.random((40, 3)), [[0.7, 0.7, 0.7]]])
    both = spark.createDataFrame(pd.DataFrame(np.concatenate([real, fake]), columns=list("abc")).assign(side=[0] * len(real) + [1] * len(fake)))
    every = np.concatenate([real, fake])
    lo, hi = every.min(axis=0), every.max(axis=0)
    want = np.array(sorted(map(tuple, np.round(brute_nearest((fake - lo) / (hi - lo), (real - lo) / (hi - lo)), 9))))
    got = np.array(sorted((round(r.d1, 9), round(r.d2, 9)) for r in fi.nearest_distances(both, list("abc")).collect()))
    assert got.shape == want.shape and np.allclose(got, want)


@pytest.mark.parametrize("sides", [2, 10])
def test_nearest_rows_with_most_points_in_one_spot(spark, sides, monkeypatch):
    monkeypatch.setattr(fi, "CELL_ROWS", 200)
    rng = np.random.default_rng(3)
    spot = lambda n: np.concatenate([0.3 + rng.normal(0, 1e-4, (9 * n // 10, sides)), rng.random((n // 10, sides))])
    points, asked = spot(6000), spot(1000)
    columns = [f"c{j}" for j in range(sides)]
    df = spark.createDataFrame(pd.DataFrame(points, columns=columns).assign(n=1))
    found = fi.two_nearest(spark.createDataFrame(pd.DataFrame(asked, columns=columns)), df, columns).toPandas().sort_values(columns)
    want = np.concatenate([brute_nearest(asked[at : at + 100], points) for at in range(0, len(asked), 100)])[np.lexsort(asked.T[::-1])]
    assert np.allclose(found[["d1", "d2"]].to_numpy(), want)


def test_compared_pairs_grow_with_the_queries_alone():
    rng = np.random.default_rng(1)
    pairs = []
    for n in (4000, 32000):
        points = np.concatenate([0.3 + rng.normal(0, 1e-5, (9 * n // 10, 3)), rng.random((n // 10, 3))])
        asked = points[rng.integers(0, n, 500)] + rng.normal(0, 1e-6, (500, 3))
        one, two, compared = fi.nearest_two(points, np.zeros(n, bool), asked, np.full(500, np.inf))
        pairs.append(compared)
        want = brute_nearest(asked[:50], points)
        assert np.allclose(np.sqrt(np.c_[one, two])[:50], want)
    assert pairs[1] < 1.6 * pairs[0] < 1.6 * 500 * 1000


def test_boxes_within_reach_are_found_without_looking_at_all():
    rng = np.random.default_rng(5)
    share = []
    for n in (4000, 32000):
        points = np.concatenate([0.3 + rng.normal(0, 1e-3, (n // 2, 2)), rng.random((n // 2, 2))])
        tree = fi.Cells(points, 32)
        low, high = (np.array([f(points[x], axis=0) for x in tree.parts]) for f in (np.min, np.max))
        boxes = fi.Boxes(tree, np.arange(len(low)), low, high)
        asked, reach = rng.random((300, 2)), np.full(300, 1e-4)
        q, cell, gap, looked = boxes.within(asked, reach)
        far = fi.box_distances(asked, low, high)
        want = np.nonzero(far < reach[:, None])
        assert sorted(zip(q, cell)) == sorted(zip(*want)) and np.array_equal(gap, far[q, cell])
        share.append(looked / far.size)
        # in rounds every cell within reach is visited once, its own first
        seen, width, met = np.zeros(300, np.int64), 1, []
        while len((some := boxes.visits(asked, np.sqrt(reach), seen, width))[0]):
            met += zip(*some)
            seen, width = seen + width, 4 * width
        assert len(set(met)) == len(met) and set(met) == set(zip(*want)) | set(enumerate(tree.of(asked)))
    assert share[1] < share[0] / 4


def test_nearest_rows_of_few_points(spark):
    asked = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "a double, b double")
    one = spark.createDataFrame([(0.0, 1.0, 1)], "a double, b double, n int")
    assert sorted(map(tuple, fi.two_nearest(asked, one, ["a", "b"]).collect())) == [(0.0, 0.0, 1.0, None), (1.0, 1.0, 1.0, None)]
    assert [r.d2 for r in fi.two_nearest(asked, one.withColumn("n", F.lit(2)), ["a", "b"]).collect()] == [1.0, 1.0]
    assert fi.two_nearest(asked, one.limit(0), ["a", "b"]).count() == 0


def test_fidelity_of_a_copy_is_perfect(spark):
    s = spark.createDataFrame([("k", i, float(i % 7 + i % 3)) for i in range(70)], "key string, i bigint, value double")
    both = s.withColumn("side", F.lit(0)).unionByName(s.withColumn("side", F.lit(1)))
    r = fi.series_fidelity(both, 7).first()
    assert (r.ks, r.profile_corr, r.fidelity_score) == (0.0, 1.0, 100.0)


def test_table_generators_keep_kinds_marginals_and_dependence(spark):
    rng = np.random.default_rng(10)
    a = rng.integers(0, 30, 4000)
    table = spark.createDataFrame(pd.DataFrame({"a": a.astype(float), "b": a * 2.0 + rng.normal(0, 3, 4000), "c": rng.choice([1.0, 5.0, 9.0], 4000, p=[0.7, 0.2, 0.1])}))
    kinds = {"a": "integer", "b": "real", "c": "category"}
    for name, least in (("bootstrap-table", None), ("bayesian-network", 0.9), ("gaussian-copula", 0.9)):
        out = sy.TABLE_GENERATORS[name](table, ["a", "b", "c"], kinds=kinds, seed=3).toPandas()
        assert len(out) == 4000 and set(out.c) == {1.0, 5.0, 9.0} and (out.a % 1 == 0).all() and 0 <= out.a.min() and out.a.max() <= 29
        assert abs((out.c == 1.0).mean() - 0.7) < 0.04 and abs(out.a.mean() - a.mean()) < 0.6
        r = np.corrcoef(out.a, out.b)[0, 1]
        assert r > least if least else abs(r) < 0.1
    with pytest.raises(ValueError, match="the fitted table"):
        sy.check_sample(table.select("a"), ["a", "b"])


def test_kinds_move_to_the_nearest_observed(spark):
    fitted = spark.createDataFrame([(1.0,), (4.0,), (8.0,)], "x double")
    sample = spark.createDataFrame([(v,) for v in (-5.0, 2.5, 2.6, 6.0, 99.0, float("nan"))], "x double")
    got = [r.x for r in sy.apply_kinds(sample, fitted, {"x": "category"}).collect()]
    assert sorted(x for x in got if x == x) == [1.0, 1.0, 4.0, 4.0, 8.0] and sum(x != x for x in got) == 1


def test_detection_tells_a_shift_and_not_a_copy(spark):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"a": rng.normal(size=1200), "b": rng.normal(size=1200), "side": np.repeat([0, 1], 600)})
    same = ut.detection_report(spark.createDataFrame(frame), ["a", "b"], folds=3, trees=5, depth=3).first()
    frame.loc[frame.side == 1, "a"] += 3.0
    moved = ut.detection_report(spark.createDataFrame(frame), ["a", "b"], folds=3, trees=5, depth=3).first()
    assert same.auc < 0.6 and moved.auc > 0.9 and moved.top_columns.startswith("a")


def test_tstr_and_seasonal_series(spark):
    s = spark.createDataFrame([("k", i, 5.0 + 4 * (i % 7 == 3) + (i * 7919 % 5) / 5) for i in range(140)], "key string, i bigint, value double")
    r = ut.tstr(s, 7).first()
    assert r.train_len == 98 and r.test_len == 42 and 0.5 < r.ratio < 3
    fake = sy.sample_seasonal(sy.fit_seasonal(s, 7), 7)
    assert fake.count() == 140 and ut.evaluate_series(s, 7).first().profile_corr > 0.9


def test_running_fit_equals_least_squares():
    rng = np.random.default_rng(3)
    y = rng.gamma(2.0, 3.0, (4, 120)) * (1 + (np.arange(120) % 7 == 2))
    fit = se.RunningFit(y, 7)
    for upto in (30, 75, 119):
        fit.advance(upto)
        for row, w in zip(y, fit.weights()):
            assert w == pytest.approx(np.linalg.lstsq(*se.design(row[:upto], 7), rcond=None)[0], rel=1e-5, abs=1e-6)
    flat = se.RunningFit(np.full((1, 60), 5.0), 7)
    flat.advance(60)
    assert se.predict(flat.weights()[0], 60, 7, 5.0, 5.0) == pytest.approx(5.0)


def test_poisson_draws_of_large_means(spark):
    rows = spark.range(4000).select(nm.poisson(F.lit(800.0), nm.uniform(1, "p", "id")).alias("k")).agg(F.avg("k"), F.stddev("k")).first()
    assert rows[0] == pytest.approx(800, abs=2) and rows[1] == pytest.approx(math.sqrt(800), rel=0.05)


def test_identification_ignores_large_means(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("t"), (F.col("id") * 7 % 13).cast("double").alias("y"), (20000 + (F.col("id") * 31 % 17) / 17.0 - 0.5).alias("x"))
    d = ca.design(rows, ca.Question("t", "y", ("x",)))
    assert ca.identify(d, ca.scaled(d))[0].shape == (3, 3)
    twice = ca.design(rows.withColumn("z", F.col("x") * 2), ca.Question("t", "y", ("x", "z")))
    with pytest.raises(ValueError, match="z is 2 x x"):
        ca.identify(twice, ca.scaled(twice))


def test_rotation_moves_every_row_once(spark, monkeypatch):
    rows = spark.range(800).select(F.col("id").alias("_id"), (F.col("id") % 2).cast("int").alias("fold"), F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    for size in (50, 10_000):
        monkeypatch.setattr(ut, "SHUFFLE_ROWS", size)
        moved = ut.rotated(rows, ["a", "b"], 7, 2, 400).collect()
        for at in (0, 1):  # two repeats of the first column
            assert sorted(r.taken[at] for r in moved) == list(map(float, range(800)))
            assert all(r.taken[at] != r["_id"] and r.taken[at] % 2 == r["_id"] % 2 for r in moved)
        assert all(r.taken[2:] == [1.0, 1.0] for r in moved) and any(r.taken[0] != r.taken[1] for r in moved)


def test_models_that_leave_out_a_fold(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 10, 900).astype(float)
    y = (rng.random(900) < 0.1 + 0.08 * x).astype(float)
    fold = np.arange(900) % 3
    rows = pd.DataFrame({"x": x, "y": y, "fold": fold})
    whole = tr.fit(spark.createDataFrame(rows), ["x"], "y", [tr.Spec(tr.LOGISTIC, without=f) for f in range(3)], "fold", trees=6, rate=0.5, depth=2)
    for f in range(3):
        alone = tr.fit(spark.createDataFrame(rows[(rows.fold != f)].assign(fold=0)), ["x"], "y", [tr.Spec(tr.LOGISTIC)], "fold", trees=6, rate=0.5, depth=2)
        grid = np.arange(10.0)[:, None]
        assert np.abs(whole.predicted(grid, [f])[0] - alone.predicted(grid, [0])[0]).max() < 0.02
        assert whole.predicted(grid, [f])[0][9] > whole.predicted(grid, [f])[0][0] + 0.4


def test_conditional_draws_of_many_labels(spark):
    rows = spark.range(6000).select((F.col("id") % 3000).cast("double").alias("a"), (F.col("id") % 3000 * 7 % 3001).cast("double").alias("b"))
    net = sy.fit_network(rows, ["a", "b"], {"a": "category", "b": "category"})
    child = 1 if net.parent[1] == 0 else 0
    counts = sy.conditional_counts(net, child)
    assert counts.count() == 3000  # pairs that occur, not 3000 x 3000
    got = sy.sample_network(net, rows, {"a": "category", "b": "category"}, 4000, smoothing=1.0).toPandas()
    kept = (got.b == got.a * 7 % 3001).mean()
    assert 2 / 3 - 0.04 < kept < 2 / 3 + 0.04  # two rows a label against a smoothing of one
    assert set(got.a) | set(got.b) <= set(map(float, range(3001))) and got.b.nunique() > 1500


def test_conditional_table_is_the_smoothed_distribution(spark):
    rows = spark.createDataFrame([(0.0, 1.0)] * 3 + [(0.0, 5.0)] + [(1.0, 3.0)] * 2, "a double, b double")
    net = sy.Network(["a", "b"], [None, 0], [0, 1], rows.select("a", "b", F.col("a").alias("b_a"), F.col("b").alias("b_b")), {})
    got = {(r.parent, r.child): r.cumulative for r in sy.conditional_table(net, 1).collect()}
    want = {(0.0, 1.0): (3 + 1 / 3) / 5, (0.0, 3.0): (3 + 2 / 3) / 5, (0.0, 5.0): 1.0, (1.0, 1.0): 1 / 9, (1.0, 3.0): (2 + 2 / 3) / 3, (1.0, 5.0): 1.0}
    assert got == pytest.approx(want)


def test_rotated_rows_are_scored_from_few_blocks(spark, monkeypatch):
    """Scores of all rotations equal those of rows that take the values of ``rotated``, without a shuffled record per row."""
    rng = np.random.default_rng(12)
    frame = pd.DataFrame({"_id": np.arange(900) * 7919, "fold": (np.arange(900) % 3).astype(np.int32), "label": (np.arange(900) // 3 % 2).astype(float), "x0": rng.normal(size=900), "x1": rng.integers(0, 9, 900).astype(float)})
    frame.loc[frame.label == 1, "x0"] += 0.7
    rows, names = spark.createDataFrame(frame).repartition(4).cache(), ["x0", "x1"]
    model = tr.fit(rows, names, "label", [tr.Spec(tr.LOGISTIC, without=f) for f in range(3)], "fold", 4, 0.3, 3)
    taken = {r["_id"]: r.taken for r in ut.rotated(rows, names, 7, 2, 300).collect()}
    want = {}
    for variant in range(5):
        x = frame[names].to_numpy()
        if variant:
            x[:, (variant - 1) // 2] = [taken[i][variant - 1] for i in frame["_id"]]
        for at, (fold, label) in enumerate(zip(frame.fold, frame.label)):
            key = (fold, variant, int(np.rint(model.predicted(x[at : at + 1], [fold])[0, 0] * 10_000)))
            p, q = want.get(key, (0, 0))
            want[key] = (p + (label == 1), q + (label == 0))
    for size, numbered in ((40, 1 << 20), (10_000, 1 << 20), (10_000, 1)):
        monkeypatch.setattr(ut, "SHUFFLE_ROWS", size)
        monkeypatch.setattr(ut, "NUMBERED", numbered)
        assert {(r.fold, r.variant, r.score): (r.p, r.q) for r in ut.permuted_scores(rows, model, names, 7, 2, 300).collect()} == want
    blocks = ut.hash_ranges(rows, names, lambda c: np.zeros((len(c[0]), 1), np.uint8), names, 7, 2, 300)
    assert blocks.count() <= 4 * 3 * 4  # partitions x folds x orders, not 900 x 4 rows


def test_few_observed_values_are_looked_up_as_many_are(spark, monkeypatch):
    fitted = spark.createDataFrame([(v,) for v in (8.0, 1.0, 4.0, None, float("nan"))], "x double")
    sample = spark.createDataFrame([(i, v) for i, v in enumerate([-5.0, 1.0, 2.5, 2.6, 4.0, 6.0, 99.0, None, float("nan")])], "i int, x double")
    found = []
    for few in (4096, 2):
        monkeypatch.setattr(sy, "FEW", few)
        moved = sy.nearest_observed(sample, fitted, "x")
        assert few == 2 or "Exchange" not in moved._jdf.queryExecution().toString()
        found.append(sorted(map(str, moved.collect())))
    assert found[0] == found[1]


def test_seasonal_fit_and_tstr_read_a_key_once(spark):
    rows = [("a", i, v) for i, v in enumerate([2.0, 0.0, 4.0, 0.0, 6.0, 0.0])] + [("b", 3, 5.0), ("b", 0, None), ("b", 1, 1.0), (None, 0, 1.0), ("c", 0, 0.0)]
    series = spark.createDataFrame(rows, "key string, i bigint, value double").repartition(3)
    got = {r.key: (r.profile, r.pool, r.n) for r in sy.fit_seasonal(series, 2).collect()}
    assert got == {"a": ([4.0, 0.0], [0.5, 1.0, 1.5], 6), "b": ([0.0, 3.0], [1 / 3, 5 / 3], 4), "c": ([0.0, 0.0], [1.0], 1)}
    long = spark.range(300).select((F.col("id") % 3).cast("string").alias("key"), F.floor(F.col("id") / 3).alias("i"), (F.col("id") * 7919 % 11).cast("double").alias("value"))
    plan = ut.tstr(long, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r.key, r.train_len, r.test_len) for r in ut.tstr(long, 7).collect()} == {(k, 70, 30) for k in "012"}


def test_origin_features_hold_no_windows_over_dense_rows(spark):
    from datetime import date, timedelta

    from stockwright.operators import boosting as bo

    first, qty = date(2024, 1, 1), {("a", d): float(d * 7919 % 13) for d in range(0, 40, 2)} | {("b", d): 1.0 for d in (5, 39)}
    panel = spark.createDataFrame([(k, first + timedelta(days=d), q) for (k, d), q in qty.items()], "sku_id string, day date, qty double").repartition(3)
    axis = dm.Axis(first, first + timedelta(days=39), 40)
    rows = bo.feature_rows(panel, axis, 7, [1, 7])
    assert rows._jdf.queryExecution().executedPlan().toString().count("Window [") == 1  # that of the sparse rows
    found = rows.collect()
    assert len(found) == 2 * 13 * 2  # items x origins 28 .. 40 x days ahead
    for r in found:
        y = [qty.get((r.sku_id, d), 0.0) for d in range(40)]
        before = y[r.i - 28 : r.i]
        assert (r.last_1, r.last_7, r.last_14) == (y[r.i - 1], y[r.i - 7], y[r.i - 14])
        assert [r.mean_7, r.mean_28, r.zero_share_28] == pytest.approx([sum(before[21:]) / 7, sum(before) / 28, before.count(0.0) / 28])
        aimed = r.i + r.days_ahead - 1
        assert r.age == r.i - (2 if r.sku_id == "a" else 5) and r.target == (y[aimed] if aimed < 40 else None)


def test_small_pools_are_looked_up_in_the_row(spark, monkeypatch):
    pool = spark.createDataFrame([("a", 5.0, 0, 90), ("a", 2.0, 90, 10), ("b", 7.0, 0, 3)], "k string, v double, before bigint, n bigint")
    draws = spark.createDataFrame([("a", 0), ("a", 89), ("a", 90), ("a", 99), ("b", 2), ("c", 0)], "k string, r bigint")
    found = draws.withColumn("v", ranks.looked_up(pool, ["k"], "v", "before")("k", "r"))
    assert [r.v for r in found.collect()] == [5.0, 5.0, 2.0, 2.0, 7.0, None]
    rows = spark.range(500).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3 + F.col("id") % 5).cast("double").alias("b"))
    made = []
    for size in (1 << 16, 1):
        monkeypatch.setattr(ranks, "POOL", size)
        assert (ranks.looked_up(pool, ["k"], "v", "before") is None) == (size == 1)
        out = sy.bayesian_network_table(rows, ["a", "b"], {}, 400)
        assert size == 1 or "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        made.append(sorted(map(tuple, out.collect())))
    assert made[0] == made[1] and len(made[0]) == 400
