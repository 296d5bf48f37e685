"""Whole groups in tasks: the same results in any order of rows, and no window or sort over the dense rows."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockwright.functions import groups
from stockwright.functions.numeric import uniform, uniforms
from stockwright.functions.ranks import value_at_rank
from stockwright.operators import demand as dm, detect as de, replenish as rp, series as se

DAY0 = date(2024, 1, 1)


def series_of(spark, items=5, days=40, seed=1):
    rng = np.random.default_rng(seed)
    y = {f"k{j}": rng.poisson(5, days + j).astype(float) for j in range(items)}
    rows = [(k, i, float(v)) for k, x in y.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    return y, spark.createDataFrame([(str(k), int(i), float(v)) for k, i, v in rows], "key string, i bigint, value double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dense_of(spark):
    lines = spark.createDataFrame([(f"s{j}", DAY0 + timedelta(days=d), float(d % 5 + j)) for j in range(3) for d in range(0, 60, 1 + j)],
                                  "sku_id string, day date, qty double")
    return dm.dense(lines, dm.Axis(DAY0, DAY0 + timedelta(days=59), 60))


def test_residuals_by_hand_in_any_order(spark):
    y, series = series_of(spark)
    got = {(r.key, r.i): r for r in se.seasonal_residuals(series.repartition(7), 7).collect()}
    assert len(got) == sum(len(x) for x in y.values())
    for k, x in y.items():
        place = np.arange(len(x)) % 7
        expected = np.array([np.median(x[place == p]) for p in place])
        residual = x - expected
        off = np.abs(residual - np.median(residual))
        scale = np.median(off) / se.MAD_TO_SIGMA if np.median(off) else off.mean() / se.MEAN_ABS_TO_SIGMA
        for i in range(len(x)):
            assert got[k, i].expected == expected[i]
            assert got[k, i].robust_z == pytest.approx((residual[i] - np.median(residual)) / max(scale, 1.0))


def test_unknown_values_are_left_out_of_medians(spark):
    rows = [("a", i, None if i == 3 else float(i % 7 + i // 7)) for i in range(28)] + [(None, i, 1.0) for i in range(28)]
    got = {(r.key, r.i): r for r in se.seasonal_residuals(spark.createDataFrame(rows, "key string, i bigint, value double"), 7).collect()}
    assert got["a", 3].residual is None and got["a", 3].robust_z is None and got["a", 3].expected == 5.0
    assert got["a", 0].expected == 1.5 and len(got) == 56


def test_dense_rows_are_neither_sorted_nor_windowed(spark):
    dense = dense_of(spark)
    series = dense.select(F.col("sku_id").alias("key"), "i", F.col("qty").alias("value"))
    panel = dense.select("sku_id", "day", "i", F.col("qty").alias("demand"), F.lit(0.0).alias("receipts"), F.lit(5.0).alias("on_hand"))
    for found in (se.seasonal_residuals(series, 7, together=True), se.lagged(series, 7, together=True), de.signal_features(panel, together=True),
                  de.weekday_median(panel, "demand", together=True), de.stock_balance(panel, together=True), de.seasonal_detector(panel, together=True)[0]):
        plan = plan_of(found)
        above = plan[: plan.rindex("Generate")]
        assert "Sort" not in above and "Window" not in above and "Exchange" not in above


def test_features_do_not_depend_on_the_order_of_rows(spark):
    dense = dense_of(spark)
    panel = dense.select("sku_id", "day", "i", F.col("qty").alias("demand"), F.lit(0.0).alias("receipts"), (F.col("i") % 9).cast("double").alias("on_hand"))
    one, two = (sorted(map(tuple, de.signal_features(p, t).collect())) for p, t in ((panel, True), (panel.repartition(5, "i"), False)))
    assert one == two and len(one) == 180
    x = np.array([r[3] for r in one if r[0] == "s1"])
    assert one[60 + 30][6] == pytest.approx((x[30] - np.median(x[27:34])) / max(x.std(), 1))
    assert one[60 + 59][6] == pytest.approx((x[59] - np.median([*x[56:60], *[x[59]] * 3])) / max(x.std(), 1))


def test_scattered_groups_are_refused(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("a", 1, 1.0)], "key string, i bigint, value double").coalesce(1)
    with pytest.raises(Exception, match="do not stand together"):
        list(groups.whole(iter([b for b in rows.toArrow().to_batches()]), "key"))


def test_a_repeated_day_is_paired_with_the_score_of_each_row(spark):
    rows = [("a", DAY0 + timedelta(days=i), i, float(i % 3)) for i in range(30)] + [("a", DAY0 + timedelta(days=4), 4, 50.0), (None, DAY0, 0, 1.0)]
    panel = spark.createDataFrame(rows, "sku_id string, day date, i bigint, demand double")
    scores, found = de.seasonal_detector(panel)
    got = [r.score for r in scores.where("sku_id = 'a' and i = 4").collect()]
    assert len(got) == 4 and len(set(got)) == 2 and scores.count() == 30 - 1 + 4 + 1
    assert found.where("i = 4").count() == 2 and scores.where("sku_id is null").first().score == 0.0


def test_value_at_every_kind_of_rank(spark):
    values = sorted([float(x) for x in np.random.default_rng(3).exponential(size=3000)] + [0.5] * 1500 + [1e9])
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    for rank in (0, 1, 1234, 2000, 4499, 4500):
        want = values[rank]
        assert value_at_rank(df, "v", rank) == (want, values.index(want), values.count(want))
    with pytest.raises(ValueError, match="no value at rank"):
        value_at_rank(df, "v", 4501)


def test_injection_collects_no_item_and_skips_items_without_demand(spark):
    rows = [(k, DAY0 + timedelta(days=i), i, 0.0 if k == "idle" else 4.0, 20.0, 4.0) for k in ("a", "b", "idle") for i in range(100)]
    panel = spark.createDataFrame(rows, "sku_id string, day date, i bigint, demand double, on_hand double, receipts double")
    made = de.inject(panel, 0.05)
    assert "collect_list" not in plan_of(made) and "Window" not in plan_of(made)
    places = made.where("kind is not null").collect()
    assert len(places) == 15 and {r.sku_id for r in places} == {"a", "b"} and made.count() == 300


def signals_of(spark, days=90, items=12):
    """A panel with a repeated day, an item without demand and rows of no item."""
    rng = np.random.default_rng(4)
    rows = [(f"k{j}", DAY0 + timedelta(days=i), i, float(rng.poisson(3) * (j > 0)), float(rng.integers(0, 40)), float(rng.integers(0, 9)))
            for j in range(items) for i in range(days)]
    rows += [("k3", DAY0 + timedelta(days=5), 5, 60.0, 7.0, 0.0), *[(None, DAY0 + timedelta(days=i), i, 2.0, None, None) for i in range(30)]]
    return spark.createDataFrame(rows, "sku_id string, day date, i bigint, demand double, on_hand double, receipts double").repartition(5, "i")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_packed_panels_give_the_results_of_rows(spark):
    panel = signals_of(spark)
    held = groups.packed(panel, "sku_id").stored("panel")
    assert held.count() == panel.count() and sorted_rows(held.rows()) == sorted_rows(panel)
    for run in (de.seasonal_detector, lambda p: de.isolation_forest(p, trees=20, samples=300)):
        (scores, found), (packed_scores, packed_found) = run(panel), run(held)
        assert sorted_rows(packed_scores.rows()) == sorted_rows(scores) and scores.count() >= panel.count()
        assert sorted_rows(packed_found) == sorted_rows(found) and found.count() > 0
        assert sorted_rows(de.top_k(packed_scores, 40)) == sorted_rows(de.top_k(scores, 40))
    made = de.inject(held, 0.03)
    assert sorted_rows(made.rows().select(*[n for n, _ in made.fields])) == sorted_rows(de.inject(panel, 0.03).select(*[n for n, _ in made.fields]))
    detectors = {"seasonal": de.seasonal_detector, "forest": lambda p: de.isolation_forest(p, trees=20, samples=300)}
    assert sorted_rows(de.score_detectors(made, detectors)) == sorted_rows(de.score_detectors(made.rows(), detectors))


def test_packed_panels_are_not_dealt_sorted_or_spelled_out(spark):
    held = groups.packed(dense_of(spark).select("sku_id", "day", "i", F.col("qty").alias("demand"), F.lit(9.0).alias("on_hand"), F.lit(0.0).alias("receipts")),
                         "sku_id").stored("panel")
    for found in (de.packed_features(held), de._seasonal_scores(held, 7)):
        plan = plan_of(found.blocks)
        assert plan.count("MapInArrow") == 1 and not any(x in plan for x in ("Exchange", "Sort", "Window", "Generate"))


def test_draws_in_tasks_are_those_of_sql(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", "7", "é漢", *["x" * int(n) for n in rng.integers(1, 90, 40)]]
    rows = [(t, int(i), int(j)) for t in texts for i, j in zip(rng.integers(-(2**62), 2**62, 9), rng.integers(-(2**31), 2**31, 9))] + [("7", None, None)]
    df = spark.createDataFrame(rows, "k string, i bigint, j int").coalesce(1)
    table = df.toArrow().combine_chunks()
    for seed, stream, keys in ((7, "inject", "ki"), (0, "tree.first", "kj"), (1 << 40, "inject.start", "k"), (3, "a stream of more than thirty-two bytes", "jik")):
        want = [r[0] for r in df.select(uniform(seed, stream, *keys)).collect()]
        assert (uniforms(seed, stream, *[groups._flat(table, k) for k in keys]) == np.array(want)).all()


def test_forest_scores_are_walks_down_every_tree(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 3)).round(1)
    grown = [de._grow(x[rng.integers(0, len(x), 64)], rng, 6) for _ in range(9)]
    whole = [de._complete(*tree, 6) for tree in grown]
    forest = {n: [tree[k] for tree in whole] for k, n in enumerate("fth")} | {"depth": 6}
    want = np.zeros(len(x))
    for row, point in enumerate(x):
        for f, t, h in grown:
            node = 0
            while f[node] >= 0:
                node = 2 * node + 1 + (point[f[node]] > t[node])
            want[row] += h[node]
    rows, place = de._distinct(x)
    assert len(rows) == len(np.unique(x, axis=0)) < len(x) and (rows[place] == x).all()
    assert de._paths(rows, forest)[place] == pytest.approx(want)


def test_numbers_at_ranks_of_blocks(spark):
    x = np.r_[np.random.default_rng(0).normal(size=400), 0.0, -0.0, 1e300, -1e300, np.inf, -np.inf, 5e-324, np.repeat(0.25, 90)]
    held = groups.packed(spark.createDataFrame([(str(i % 5), float(v)) for i, v in enumerate(x)], "k string, v double"), "k").stored("numbers")
    known = np.sort(x)
    for rank in (0, 1, 200, 204, 300, len(x) - 1):
        v = known[rank]
        assert de.value_at(held.select("v"), lambda table: de._values(table, "v"), rank) == (v, (x < v).sum(), (x == v).sum())
    with pytest.raises(ValueError, match="no value at rank"):
        de.value_at(held, lambda table: de._values(table, "v"), len(x))


def test_packed_replay_is_the_daily_replay(spark, monkeypatch):
    rows = [(f"s{j}", [0, 3, None, 59, 60][j % 2:], [2.0, 5.0, 7.0, 1.0, 9.0][j % 2:], 3.0, 12.0) for j in range(7)] + [("none", [], [], None, 4.0)]
    items = spark.createDataFrame(rows, "sku_id string, idx array<int>, qty array<double>, reorder_point double, order_up_to double")
    axis = dm.Axis(DAY0, DAY0 + timedelta(days=59), 60)
    monkeypatch.setattr(groups, "ROWS", 150)
    held = rp.packed_replay(items, axis).stored("signals")
    daily = rp.daily_replay(items, axis)
    assert sorted_rows(held.drop("i").rows()) == sorted_rows(daily) and held.count() == 8 * 60
    assert held.rows().where(F.datediff("day", F.lit(DAY0)) != F.col("i")).count() == 0
    got = {(r.sku_id, r.day): r.demand for r in daily.collect()}
    assert got["s0", DAY0 + timedelta(days=3)] == 5.0 and sum(v for (k, _), v in got.items() if k == "s0") == 8.0


def test_profiles_and_series_of_one_aggregation_equal_the_two(spark):
    rng = np.random.default_rng(8)
    lines = [(f"s{j}" if j < 9 else None, DAY0 + timedelta(days=int(d)), int(q)) for j, d, q in zip(rng.integers(0, 10, 400), rng.integers(0, 60, 400), rng.integers(0, 9, 400))]
    lines += [("s1", None, 4), ("late", DAY0 + timedelta(days=50), 2), ("unknown", None, 1), ("empty", DAY0, None)]
    orders = spark.createDataFrame([(k, d, q, "shipped") for k, d, q in lines], "sku_id string, ts date, quantity int, status string")
    axis, panel = dm.Axis(DAY0, DAY0 + timedelta(days=59), 60), dm.item_day_demand(orders)
    for days in (60, 40):
        apart = dm.profiles(panel.where(F.col("day") < F.date_add(F.lit(DAY0), days)), days).where("mean > 0").join(dm.series(panel, axis), "sku_id")
        both = dm.profiled_series(panel, axis, days).where("mean > 0")
        assert both.columns == apart.columns and plan_of(both).count("Exchange") < plan_of(apart).count("Exchange")
        want, got = ({r.sku_id: r for r in df.collect()} for df in (apart, both))
        assert want.keys() == got.keys() and ("late" in got) == (days == 60) and "s1" in got
        for k, row in want.items():
            assert [got[k][n] for n in ("total", "idx", "qty", "intermittent")] == [row[n] for n in ("total", "idx", "qty", "intermittent")]
            assert [got[k][n] for n in ("mean", "std", "zero_ratio", "variability", "daily_rate")] == pytest.approx(
                [row[n] for n in ("mean", "std", "zero_ratio", "variability", "daily_rate")], abs=1e-12)


def test_groups_of_one_size_and_of_many_give_the_same(spark):
    y, equal = series_of(spark, items=4)
    equal = equal.where("i < 40")
    mixed = equal.unionByName(spark.createDataFrame([("short", i, 1.0) for i in range(17)], "key string, i bigint, value double"))
    alone, among = (sorted_rows(se.seasonal_residuals(s.repartition(1), 7).where("key <> 'short'")) for s in (equal, mixed))
    assert alone == among and len(alone) == 160
