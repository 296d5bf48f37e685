"""KPIs, datasets, stock rules, occupancy and stocktake: the relational part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import ratio


def available() -> Column:
    return F.greatest(F.lit(0), F.col("on_hand") - F.col("reserved"))


# --- datasets --------------------------------------------------------------------------------------


def order_lines(orders: DataFrame, sku: DataFrame) -> DataFrame:
    """Every order line, cancelled ones included, with its item's attributes and value."""
    known = sku.select("sku_id", "category", "abc_class", "unit_price")
    return orders.join(known, "sku_id", "left").select(
        F.to_date("ts").alias("date"), "sku_id", "category", "abc_class", "channel", "priority", "status", "quantity",
        F.round(F.col("quantity") * F.col("unit_price"), 2).alias("line_value"),
    )


def inventory_lines(inventory: DataFrame, sku: DataFrame, location: DataFrame) -> DataFrame:
    """Every stock position with item and location attributes, available units and value at cost."""
    known = sku.select("sku_id", "category", "abc_class", "unit_cost")
    zones = location.select("location_id", "zone")
    return inventory.join(known, "sku_id", "left").join(zones, "location_id", "left").select(
        "sku_id", "category", "abc_class", "location_id", "zone", "on_hand", "reserved",
        available().alias("available"), "in_transit",
        F.round(F.col("on_hand") * F.col("unit_cost"), 2).alias("stock_value"),
    )


def sku_catalogue(sku: DataFrame) -> DataFrame:
    return sku.select("sku_id", "name", "category", "abc_class", "unit_cost", "unit_price", "shelf_life_days")


def plan_dataset(planned: DataFrame, sku: DataFrame) -> DataFrame:
    """The replenishment plan with item attributes and readable flags."""
    return planned.join(sku.select("sku_id", "category", "abc_class"), "sku_id", "left").select(
        "sku_id", "category", "abc_class",
        F.when(F.col("intermittent"), "intermittent").otherwise("smooth").alias("demand_shape"),
        F.when(F.col("order_qty") > 0, "yes").otherwise("no").alias("needs_order"),
        F.col("mean").alias("mean_daily_demand"), "safety_stock", "reorder_point", "order_up_to", "available", "order_qty",
    )


# --- KPIs ------------------------------------------------------------------------------------------


def stock_value(inventory: DataFrame, sku: DataFrame) -> DataFrame:
    """Units on hand over all positions and their value over positions of known items."""
    known = sku.select("sku_id", "unit_cost")
    return inventory.join(known, "sku_id", "left").agg(
        F.sum("on_hand").alias("total_on_hand"), F.sum(F.col("on_hand") * F.col("unit_cost")).alias("inventory_value")
    )


def kpis(sku: DataFrame, inventory: DataFrame, orders: DataFrame) -> DataFrame:
    """One row of portfolio KPIs; three one-row aggregates read as scalar subqueries."""
    lines = orders.agg(
        F.count(F.lit(1)).alias("outbound_lines"),
        F.count_if(F.col("status") == "cancelled").alias("_c"),
        F.count_if(F.col("priority") == "express").alias("_e"),
    )
    stock = stock_value(inventory, sku)
    n = F.greatest(F.lit(1), F.col("outbound_lines"))
    return lines.select(
        sku.agg(F.count_distinct("sku_id").alias("n")).scalar().alias("total_skus"),
        stock.select("total_on_hand").scalar().alias("total_on_hand"),
        F.round(stock.select("inventory_value").scalar(), 2).alias("inventory_value"),
        "outbound_lines",
        F.round(F.col("_c") / n, 4).alias("cancel_rate"),
        F.round(F.col("_e") / n, 4).alias("express_rate"),
    )


def abc_distribution(sku: DataFrame) -> DataFrame:
    return sku.groupBy("abc_class").agg(F.count(F.lit(1)).alias("n")).orderBy("abc_class")


def top_movers(profiles: DataFrame, sku: DataFrame, n: int = 8) -> DataFrame:
    """The n items of highest daily rate; the join reads n rows only."""
    top = profiles.select("sku_id", "daily_rate").orderBy(F.desc("daily_rate"), "sku_id").limit(n)
    named = sku.select("sku_id", "name", "abc_class").join(F.broadcast(top), "sku_id", "right")  # n rows
    return named.select(
        "sku_id", F.coalesce("name", F.lit("?")).alias("name"), F.coalesce("abc_class", F.lit("?")).alias("abc_class"),
        F.round("daily_rate", 2).alias("avg_daily_demand"),
    )


def stock_rules(inventory: DataFrame, profiles: DataFrame, dead_stock_over: int = 100) -> DataFrame:
    """Stockouts, and dead stock: no demand and more than ``dead_stock_over`` units on hand."""
    free = available()
    kind = F.when(free == 0, "stockout").when(
        (F.coalesce("daily_rate", F.lit(0.0)) == 0.0) & (F.col("on_hand") > dead_stock_over), "dead_stock"
    )
    return (
        inventory.join(profiles.select("sku_id", "daily_rate"), "sku_id", "left")
        .select(kind.alias("type"), "sku_id", "location_id", "on_hand")
        .where(F.col("type").isNotNull())
    )


# --- readings -------------------------------------------------------------------------------------


def latest_reading(readings: DataFrame, modality: str | None = None) -> DataFrame:
    """The latest reading per location; the larger reading id wins a tie.

    ``max_by`` keeps one row per location and task before the shuffle, so a location with most of
    the readings is no hot group.
    """
    rows = readings if modality is None else readings.where(F.col("modality") == modality)
    value = F.struct(*[c for c in rows.columns if c != "location_id"])
    return rows.groupBy("location_id").agg(F.max_by(value, F.struct("ts", "reading_id")).alias("_r")).select("location_id", "_r.*")


def member(name: str) -> Column:
    """A number in the JSON ``meta`` of a reading."""
    return F.get_json_object("meta", f"$.{name}").cast("double")


def stocktake(latest: DataFrame, rel_threshold: float = 0.25, min_abs: float = 15) -> DataFrame:
    """Estimated against booked units per location, with the flag, its direction and its relative size."""
    book, est = F.coalesce(member("book_units"), F.lit(0.0)), F.coalesce(member("est_units"), F.lit(0.0))
    shaped = latest.select("location_id", book.alias("book_units"), est.alias("vision_units"), (est - book).alias("diff"))
    rel = F.abs("diff") / F.greatest(F.lit(1.0), F.col("book_units"))
    return shaped.withColumn("rel", rel).withColumns({
        "flagged": (F.abs("diff") >= min_abs) & (F.col("rel") >= rel_threshold),
        "direction": F.when(F.col("diff") < 0, "shortage").otherwise("surplus"),
    })


def stocktake_summary(checked: DataFrame) -> DataFrame:
    flagged = F.count_if("flagged")
    total = F.count(F.lit(1))
    return checked.agg(
        total.alias("locations_scanned"), (total - flagged).alias("matched"), flagged.alias("flagged"),
        F.round((total - flagged) / F.greatest(F.lit(1), total), 4).alias("match_rate"),
        F.coalesce(F.sum(F.when(F.col("flagged"), F.col("diff"))), F.lit(0.0)).alias("net_unit_variance"),
    )


def top_discrepancies(checked: DataFrame, n: int = 20) -> DataFrame:
    return checked.where("flagged").orderBy(F.desc(F.abs("diff")), "location_id").limit(n)


def occupancy(latest: DataFrame, location: DataFrame) -> DataFrame:
    """Latest occupancy joined to its location: one row per cell."""
    return latest.join(location.select("location_id", "zone", "aisle"), "location_id").select(
        "zone", "aisle", "location_id", F.col("value").alias("occupancy"),
        member("book_units").alias("book_units"), member("est_units").alias("est_units"),
    )


def occupancy_grid(cells: DataFrame) -> DataFrame:
    """Zone and aisle with their cells in order; an aisle holds as many cells as it has locations."""
    packed = F.sort_array(F.collect_list(F.struct("location_id", "occupancy", "book_units", "est_units")))
    return cells.groupBy("zone", "aisle").agg(packed.alias("cells")).orderBy("zone", "aisle")


# --- structural quality ---------------------------------------------------------------------------


def structural_quality(sku: DataFrame, location: DataFrame, inventory: DataFrame, orders: DataFrame,
                       least_coverage: float = 0.99) -> DataFrame:
    """Reference and sanity checks in one row; passes only if every check holds."""
    items, places = sku.select("sku_id"), location.select("location_id")
    lost = inventory.join(items, "sku_id", "left_anti").select(F.lit(1).alias("x")).unionAll(
        inventory.join(places, "location_id", "left_anti").select(F.lit(1).alias("x"))
    ).agg(F.count("x").alias("n"))
    strangers = orders.select("sku_id").distinct().join(items, "sku_id", "left_anti").agg(F.count("sku_id").alias("n"))
    covered = inventory.agg(
        F.count_distinct("sku_id").alias("covered"),
        F.count_if((F.col("on_hand") < 0) | (F.col("reserved") < 0)).alias("negative"),
    )
    known = sku.agg(F.count_distinct("sku_id").alias("n")).scalar()
    coverage = ratio(F.col("covered"), F.greatest(F.lit(1), F.col("sku_count")))
    out = covered.select("covered", "negative", known.alias("sku_count"), lost.scalar().alias("_lost"),
                         strangers.scalar().alias("_strangers")).select(
        (F.col("_lost") == 0).alias("inventory_references"),
        (F.col("negative") == 0).alias("inventory_non_negative"),
        (F.col("_strangers") == 0).alias("outbound_references"),
        (coverage >= least_coverage).alias("sku_coverage_full"),
        "sku_count", F.round(coverage, 4).alias("sku_coverage"),
    )
    checks = ["inventory_references", "inventory_non_negative", "outbound_references", "sku_coverage_full"]
    return out.withColumn("passed", F.col(checks[0]) & F.col(checks[1]) & F.col(checks[2]) & F.col(checks[3]))
