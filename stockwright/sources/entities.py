"""From source rows to entities, datasets and model tables; entity checks; the retail layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import half_even
from ..functions.ranks import exact_medians, exact_quantiles
from ..functions.times import DATE_FORMATS, time_value
from ..session import cut
from . import delimited as de
from .records import PLACE, cells, records
from .tables import hash_sample

# Allowed texts per entity field.
ABC_CLASSES = ["A", "B", "C", "?"]
INBOUND_STATUSES = ["created", "in_transit", "received"]
OUTBOUND_STATUSES = ["created", "picked", "shipped", "cancelled"]
CHANNELS = ["ecommerce", "wholesale", "store"]
PRIORITIES = ["standard", "express"]
MODALITIES = ["temperature", "humidity", "occupancy", "vision_occupancy"]

# Per entity and field, the rules in the order they are checked.
RULES: dict[str, list[tuple]] = {
    "sku": [("sku_id", "id"), ("unit_cost", "not_negative"), ("unit_price", "not_negative"), ("weight_kg", "not_negative"),
            ("volume_m3", "not_negative"), ("abc_class", "one_of", ABC_CLASSES), ("shelf_life_days", "optional_positive")],
    "location": [("location_id", "id"), ("level", "not_negative"), ("capacity_units", "not_negative")],
    "inventory": [("sku_id", "id"), ("location_id", "id"), ("on_hand", "not_negative"), ("reserved", "not_negative"), ("in_transit", "not_negative")],
    "inbound": [("order_id", "id"), ("sku_id", "id"), ("supplier_id", "id"), ("quantity", "positive"), ("lead_time_days", "not_negative"),
                ("status", "one_of", INBOUND_STATUSES)],
    "outbound": [("order_id", "id"), ("sku_id", "id"), ("quantity", "positive"), ("channel", "one_of", CHANNELS), ("priority", "one_of", PRIORITIES),
                 ("status", "one_of", OUTBOUND_STATUSES)],
    "sensor": [("location_id", "id"), ("modality", "one_of", MODALITIES), ("value", "finite")],
}


def _problem(rule: tuple) -> Column:
    """NULL when the field is fine, else ``field: problem``."""
    name, kind = rule[0], rule[1]
    col = F.col(name)
    if kind == "id":
        bad, text = F.coalesce(F.trim(col) == "", F.lit(True)), "must be a non-empty string"
    elif kind == "one_of":
        bad, text = ~F.coalesce(col.isin(rule[2]), F.lit(False)), f"must be one of {sorted(rule[2])}"
    else:
        n = col.cast("double")
        finite = col.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
        if kind == "finite":
            bad, text = ~finite, "must be a finite number"
        elif kind == "not_negative":
            bad, text = ~finite | (n < 0), "must be a finite number that is not negative"
        elif kind == "positive":
            bad, text = ~finite | (n <= 0), "must be a finite positive number"
        else:
            bad, text = col.isNotNull() & (~finite | (n <= 0)), "must be a finite positive number"
    return F.when(bad, F.lit(f"{name}: {text}"))


def checked(rows: DataFrame, entity: str) -> DataFrame:
    """Rows with ``violations``, the list of problems in rule order (empty when accepted); the first one names the row."""
    rules = [r for r in RULES[entity] if r[0] in rows.columns]
    return rows.withColumn("violations", F.array_compact(F.array(*[_problem(r) for r in rules])))


def split_checked(rows: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """``(accepted, quarantined)``; quarantined rows keep their first problem."""
    found = checked(rows, entity)
    return found.where(F.size("violations") == 0).drop("violations"), found.where(F.size("violations") > 0).withColumn("problem", F.col("violations")[0])


def violation_counts(rows: DataFrame, entity: str) -> DataFrame:
    """Rows per violated field."""
    return checked(rows, entity).select(F.explode("violations").alias("v")).groupBy(F.substring_index("v", ":", 1).alias("field")).agg(
        F.count(F.lit(1)).alias("n"))


# --- canonical entities from a source ----------------------------------------------------------------------


def canonical(rows: DataFrame, roles: dict) -> tuple[DataFrame, DataFrame]:
    """``(skus, orders)`` from parsed rows by roles: zero quantities dropped, negative ones cancelled, prices medians.

    Without an item role every row is the item ``all``; medians are exact and split by value range, so one item may
    own most rows.
    """
    if "time" not in roles or "quantity" not in roles:
        raise ValueError("the source has no demand: declare its time and quantity columns")

    def role(name: str) -> Column:
        return F.col(f"`{roles[name]}`") if name in roles else F.lit(None)

    item = role("item").cast("string") if "item" in roles else F.lit("all")
    shaped = rows.select(item.alias("sku_id"), role("time").alias("ts"), half_even(role("quantity").cast("double")).alias("_q"),
                         *[F.when(role(x).cast("double") > 0, role(x).cast("double")).alias(f"_{x}") for x in ("price", "cost")])
    kept = shaped.where(F.col("sku_id").isNotNull() & (F.col("_q") != 0))
    orders = kept.select("ts", "sku_id", F.abs("_q").alias("quantity"), F.lit("ecommerce").alias("channel"), F.lit("standard").alias("priority"),
                         F.when(F.col("_q") > 0, "shipped").otherwise("cancelled").alias("status"))
    named = kept.select("sku_id").distinct()
    middle = exact_medians(kept, ["sku_id"], ["_price", "_cost"])
    price = F.coalesce("_price", F.lit(0.0))
    skus = named.join(middle, "sku_id", "left").select(
        "sku_id", F.col("sku_id").alias("name"), F.lit("unknown").alias("category"),
        F.coalesce("_cost", F.round(price * 0.6, 2)).alias("unit_cost"), price.alias("unit_price"),
        F.lit(0.1).alias("weight_kg"), F.lit(0.001).alias("volume_m3"), F.lit("?").alias("abc_class"),
    )
    return skus, orders


def dataset(rows: DataFrame, schema: de.Schema, times_of_day: list[str] = [], columns: list[str] | None = None, limit: int | None = None,
            seed: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """The dataset view of a source: times as ISO days (plus an hour field), text columns left out, snake-case names.

    ``limit`` with ``seed`` is a uniform sample; without, the first rows.
    """
    chosen = columns if columns is not None else schema.names
    unknown = [c for c in chosen if c not in schema.names]
    if unknown:
        raise ValueError(f"the source has no column {unknown[0]!r}")
    if limit is not None:
        rows = hash_sample(rows, limit, seed, keys or schema.names) if seed is not None else rows.limit(limit)
    out, taken = [], set()

    def name(base: str) -> str:
        n, k = base, 1
        while n in taken:
            k += 1
            n = f"{base}_{k}"
        taken.add(n)
        return n

    for spec in schema.columns:
        if spec.kind == "text":
            continue
        base, col = de.field_name(spec.name), F.col(f"`{spec.name}`")
        fields = [(name(base), F.date_format(col, "yyyy-MM-dd") if spec.kind == "time" else col)]
        if spec.kind == "time" and spec.name in times_of_day:
            fields.append((name(base + "_hour"), F.date_format(col, "HH")))
        if spec.name in chosen:
            out += [c.alias(n) for n, c in fields]
    return rows.select(*out)


# --- model tables ------------------------------------------------------------------------------------------


def feature_table(rows: DataFrame, time: str, quantity: str, price: str, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``(qty, price, hour, weekday)`` of all rows with positive quantity and price; with ``limit``, the first in ``order``."""
    kept = rows.where((F.col(quantity) > 0) & (F.col(price) > 0) & F.col(time).isNotNull())
    if limit is not None:
        kept = kept.orderBy(*order).limit(limit) if order else kept.limit(limit)
    return kept.select(F.col(quantity).cast("double").alias("qty"), F.col(price).cast("double").alias("price"),
                       F.hour(time).cast("double").alias("hour"), F.weekday(time).cast("double").alias("weekday"))


def copula_input(rows: DataFrame, columns: list[str], quantity: str, limit: int | None = None, seed: int = 1, keys: list[str] | None = None) -> DataFrame:
    """All complete positive rows below the 99 % quantile of quantity; with ``limit``, a seeded sample of so many."""
    kept = rows.select(*dict.fromkeys([*columns, *(keys or [])])).dropna().where(F.col(quantity) > 0)
    border = exact_quantiles(kept, [], quantity, {"q": 0.99}).scalar()
    below = kept.where(F.col(quantity) < border)
    return (below if limit is None else hash_sample(below, limit, seed, keys or columns)).select(*columns)


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """``(label, code)``: 0 for the most frequent label, ties to the smaller label.

    A label's code is the number of labels with a larger count plus its place among labels of its own count.
    Those places are counted inside label ranges cut at sampled labels, so a column of a billion labels that
    all occur once is still many small sorts.
    """
    counts = cut(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")))
    borders = sorted(r.label for r in counts.orderBy(F.xxhash64("label")).limit(4096).collect())[::16]  # at most 256
    at = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b <= F.col("label"))) if borders else F.lit(0)
    placed = counts.withColumn("_g", at)
    sizes = placed.groupBy("n", "_g").agg(F.count(F.lit(1)).alias("labels"))
    per_count = sizes.groupBy("n").agg(F.sum("labels").alias("labels"))  # one row per distinct count
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    larger = per_count.select("n", F.coalesce(F.sum("labels").over(before.orderBy(F.desc("n"))), F.lit(0)).alias("_larger"))
    ranges = sizes.select("n", "_g", F.coalesce(F.sum("labels").over(before.partitionBy("n").orderBy("_g")), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("n", "_g").orderBy("label")) - 1
    found = placed.select("label", "n", "_g", place.alias("_place")).join(ranges, ["n", "_g"]).join(larger, "n")
    return found.select("label", (F.col("_larger") + F.col("_ahead") + F.col("_place")).cast("double").alias("code"))


def model_table(rows: DataFrame, numeric: list[str], categories: list[str] = [], time: str | None = None, parts: list[str] = [],
                positive: list[str] = [], limit: int | None = None, seed: int | None = None, keys: list[str] | None = None):
    """Complete rows as numbers for a table synthesizer, with the codes of each category to decode by.

    ``parts`` adds ``<time>.hour`` / ``<time>.weekday``.  Returns ``(table, {category: codes})``.
    """
    derived = {"hour": F.hour, "weekday": F.weekday}
    cols = [F.col(c).cast("double").alias(c) for c in numeric] + [F.col(c).cast("string").alias(c) for c in categories]
    cols += [derived[p](F.col(time)).cast("double").alias(f"{time}_{p}") for p in parts]
    names = [*numeric, *categories, *[f"{time}_{p}" for p in parts]]
    extra = [k for k in keys or [] if k not in names]
    kept = rows.select(*cols, *extra).dropna()
    for c in positive:
        kept = kept.where(F.col(c) > 0)
    if limit is not None:
        kept = hash_sample(kept, limit, seed, keys or names) if seed is not None else kept.limit(limit)
    kept = cut(kept.select(*names))
    codes = {c: category_codes(kept, c) for c in categories}
    out = kept
    for c, table in codes.items():
        out = out.join(table.withColumnRenamed("code", f"_{c}"), F.col(c) == F.col("label")).drop(c, "label").withColumnRenamed(f"_{c}", c)
    return out.select(*names), codes


def decode(rows: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Codes back to labels: rounded (halves up) and clipped to a known code."""
    out = rows
    for c, table in codes.items():
        top = table.agg(F.max("code").alias("m")).scalar()
        code = F.least(F.greatest(F.floor(F.col(c) + 0.5).cast("double"), F.lit(0.0)), top)
        out = out.withColumn("_code", code).join(table.select("code", F.col("label").alias("_label")), F.col("_code") == F.col("code"), "left").select(
            *[F.col("_label").alias(x) if x == c else F.col(x) for x in rows.columns])
    return out


# --- the retail layout -------------------------------------------------------------------------------------


def read_retail(spark: SparkSession, path: str, date_format: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(skus, orders, report)`` of a retail CSV: every row gets a skip reason or is kept.

    The report counts rows by reason (NULL = kept).  A code's first row in the file names it.
    """
    names = de.read_header(spark, path, ",")
    have = set(names)
    raw = cells(records(spark, path), names, ",").withColumnsRenamed({f"c{i}": n for i, n in enumerate(names)})

    def text(*names: str) -> Column:
        found = [F.trim(F.col(f"`{n}`")) for n in names if n in have]
        return F.nullif(F.coalesce(*found), F.lit("")) if found else F.lit(None).cast("string")

    formats = [date_format] if date_format else DATE_FORMATS
    price_text = F.coalesce(text("Price", "UnitPrice"), F.lit("0"))
    rows = raw.select(
        F.struct(*PLACE).alias("_row"),  # file order
        text("StockCode").alias("code"), text("Description").alias("description"), text("Invoice", "InvoiceNo").alias("invoice"),
        de.number(text("Quantity")).alias("_qty"), de.number(price_text).alias("price"), time_value(text("InvoiceDate"), formats).alias("ts"),
    ).withColumn("qty", F.when(F.col("_qty") >= 0, F.floor("_qty")).otherwise(F.ceil("_qty")))
    reason = (
        F.when(F.col("code").isNull(), "missing StockCode")
        .when(F.col("qty").isNull() | F.col("price").isNull(), "non-numeric Quantity or Price")
        .when(F.col("qty") == 0, "zero Quantity")
        .when(F.col("ts").isNull(), "unparseable InvoiceDate")
        .when(F.col("price") < 0, "invalid_record")
    )
    marked = cut(rows.withColumn("skip_reason", reason))
    report = marked.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))
    kept = marked.where(F.col("skip_reason").isNull())
    first = kept.groupBy("code").agg(F.min_by(F.struct("description", "price"), "_row").alias("f"))
    skus = first.select(
        F.col("code").alias("sku_id"), F.coalesce("f.description", "code").alias("name"), F.lit("retail").alias("category"),
        F.round(F.col("f.price") * 0.6, 2).alias("unit_cost"), F.col("f.price").alias("unit_price"), F.lit(0.1).alias("weight_kg"),
        F.lit(0.001).alias("volume_m3"), F.lit("?").alias("abc_class"))
    orders = kept.select(
        F.concat_ws("-", F.coalesce("invoice", F.lit("INV")), F.hex(F.xxhash64("_row._file", "_row._block", "_row._line"))).alias("order_id"), "ts", F.col("code").alias("sku_id"),
        F.abs("qty").cast("bigint").alias("quantity"), F.lit("ecommerce").alias("channel"), F.lit("standard").alias("priority"),
        F.when(F.col("qty") > 0, "shipped").otherwise("cancelled").alias("status"))
    return skus, orders, report
