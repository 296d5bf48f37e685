"""Cross-tabulation with totals computed from rows: filters, grains, shares, folding and label order.

The rows are first reduced to one row per full key, then grouping sets run over that reduction, so the
expansion into levels multiplies groups, not order lines.  Distinct counts and medians keep the value in the
key, with counts, and never hold a group's values in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import ratio
from ..functions.ranks import quantiles_of_counts
from ..functions.times import GRAINS, WEEKDAYS, time_key
from ..session import cut

AGGREGATIONS = ["sum", "count", "count_distinct", "mean", "median", "min", "max"]
SHOW_AS = ["value", "share_of_total", "share_of_row", "share_of_column"]
OTHER = "Other"


@dataclass(frozen=True)
class View:
    """What to show: axes as ``field`` or ``(field, grain)``, values as ``(field, aggregate)``."""

    rows: list = field(default_factory=list)
    columns: list = field(default_factory=list)
    values: list = field(default_factory=list)
    filters: dict = field(default_factory=dict)
    show_as: str = "value"
    max_columns: int | None = None


def _axis(specs: list) -> list[tuple[str, str | None]]:
    return [(s, None) if isinstance(s, str) else (s[0], s[1]) for s in specs]


def check_view(df: DataFrame, view: View) -> None:
    """Refuse a view whose fields, grains, aggregates or filters do not fit the table."""
    kinds = dict(df.dtypes)
    for name, grain in [*_axis(view.rows), *_axis(view.columns)]:
        if name not in kinds:
            raise ValueError(f"no column {name!r}")
        if grain is not None and kinds[name] != "date":
            raise ValueError(f"{name} holds no dates, so it has no grain")
        if grain is not None and grain not in GRAINS:
            raise ValueError(f"no grain {grain!r} (there are {', '.join(GRAINS)})")
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    for name, agg in view.values:
        if name not in kinds:
            raise ValueError(f"no column {name!r}")
        if agg not in AGGREGATIONS:
            raise ValueError(f"no aggregate {agg!r} (there are {', '.join(AGGREGATIONS)})")
        if agg not in ("count", "count_distinct") and not kinds[name].startswith(("decimal", *numeric)):
            raise ValueError(f"{agg} takes numbers, and {name} holds none")
    for name, rule in view.filters.items():
        if name not in kinds:
            raise ValueError(f"no column {name!r}")
        if len([k for k in ("include", "exclude") if k in rule]) != 1 or len(rule) != 1:
            raise ValueError(f"a filter is one list, include or exclude: {name} has {sorted(rule)}")
    if view.show_as not in SHOW_AS:
        raise ValueError(f"no way {view.show_as!r} to show values (there are {', '.join(SHOW_AS)})")


def listed(name: str, values: list) -> Column:
    """Whether a raw value is in a list in which NULL may be listed."""
    known = [v for v in values if v is not None]
    inside = F.coalesce(F.col(name).isin(known), F.lit(False)) if known else F.lit(False)
    return inside | F.col(name).isNull() if None in values else inside


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """Keep the rows of every include list and drop those of every exclude list."""
    for name, rule in filters.items():
        df = df.where(listed(name, rule["include"]) if "include" in rule else ~listed(name, rule["exclude"]))
    return df


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """Distinct raw values of a field with their row counts."""
    return df.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def kept_count(values: DataFrame, rule: dict) -> DataFrame:
    """How many distinct values a filter keeps."""
    keep = listed("value", rule["include"]) if "include" in rule else ~listed("value", rule["exclude"])
    return values.agg(F.count_if(keep).alias("kept"))


def natural_key(text: Column) -> Column:
    """A text whose plain order is natural order: digit runs are padded, so item2 comes before item10."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def label_keys(label: Column) -> list[Column]:
    """Sort keys of a label: the folded column and blanks last, weekdays Mon..Sun, then natural text."""
    last = F.when(label.isNull(), 2).when(label == OTHER, 1).otherwise(0)
    week = F.coalesce(F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), label), F.lit(0))
    return [last, week, natural_key(label)]


def _keyed(df: DataFrame, view: View) -> tuple[DataFrame, list[str], list[str]]:
    """The filtered rows with text keys ``r1.., c1..`` and the value fields ``f1..``."""
    kinds = dict(df.dtypes)

    def key(name: str, grain: str | None) -> Column:
        return time_key(F.col(name), grain or "day") if kinds[name] == "date" else F.col(name).cast("string")

    rows, cols = _axis(view.rows), _axis(view.columns)
    out = apply_filters(df, view.filters).select(
        *[key(*a).alias(f"r{i + 1}") for i, a in enumerate(rows)],
        *[key(*a).alias(f"c{i + 1}") for i, a in enumerate(cols)],
        *[F.col(name).alias(f"f{i + 1}") for i, (name, _) in enumerate(view.values)],
    )
    return out, [f"r{i + 1}" for i in range(len(rows))], [f"c{i + 1}" for i in range(len(cols))]


def _levels(rows: list[str], cols: list[str]) -> list[list[str]]:
    prefixes = [rows[:d] for d in range(len(rows) + 1)]
    return [p + tail for p in prefixes for tail in ([[], cols] if cols else [[]])]


def _leveled(df: DataFrame, rows: list[str], cols: list[str], extra: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregate at every level; ``depth`` counts the row keys present, ``cell`` tells whether columns are."""
    keys = [*rows, *cols]
    if not keys:
        return df.groupBy(*extra).agg(*aggs).select(F.lit(0).alias("depth"), F.lit(False).alias("cell"), "*")
    sets = [level + extra for level in _levels(rows, cols)]
    depth = sum([(F.lit(1) - F.grouping(k).cast("int")) for k in rows], F.lit(0))
    cell = (F.grouping(cols[0]) == 0) if cols else F.lit(False)
    # the empty level is one of the sets, so "grouping" marks totals apart from NULL labels
    return df.groupingSets(sets, *keys, *extra).agg(*aggs, depth.alias("depth"), cell.alias("cell"))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


#: Distinct values of a column up to which a group's values are ordered in one window; beyond, value ranges are.
WINDOW_VALUES = 20_000


def _reduced(keyed: DataFrame, keys: list[str], values: list) -> DataFrame:
    """One row per (keys, ``_j``, value): ``_j`` 0 holds sums, counts and extremes of the keys, and ``_j`` i counts the
    values of the i-th column where these are needed one by one (medians ``_d``, distinct values ``_s``).  One shuffle."""
    none = (F.lit(None).cast("string"), F.lit(None).cast("double"))
    kinds = [(0, *none)]
    aggs = [F.count(F.lit(1)).alias("n")]
    first = F.col("_j") == 0
    for i, (_, agg) in enumerate(values, start=1):
        f = F.col(f"f{i}")
        if agg == "median":
            kinds.append((i, none[0], f.cast("double")))
        elif agg == "count_distinct":
            kinds.append((i, f.cast("string"), none[1]))
        elif agg in ("sum", "mean"):
            aggs += [F.sum(F.when(first, f.cast("double"))).alias(f"s{i}"), F.count(F.when(first, f)).alias(f"k{i}")]
        elif agg in ("min", "max"):
            aggs.append((F.min if agg == "min" else F.max)(F.when(first, f.cast("double"))).alias(f"s{i}"))
    if len(kinds) == 1:
        return keyed.select("*", F.lit(0).alias("_j"), none[0].alias("_s"), none[1].alias("_d")).groupBy(*keys, "_j", "_s", "_d").agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), x.alias("s"), d.alias("d")) for j, x, d in kinds]))
    melted = keyed.withColumn("_x", each).select(*keyed.columns, F.col("_x.j").alias("_j"), F.col("_x.s").alias("_s"), F.col("_x.d").alias("_d"))
    return cut(melted.where(first | F.col("_s").isNotNull() | F.col("_d").isNotNull()).groupBy(*keys, "_j", "_s", "_d").agg(*aggs))


def _rolled_up(counted: DataFrame, rows: list[str], cols: list[str], x: str) -> DataFrame:
    """Value counts of every level, each added up from those of the next finer level: ``depth, cell, keys, x, n``."""
    def add(finer: DataFrame, keys: list[str]) -> DataFrame:
        return finer.groupBy(*keys, x).agg(F.sum("n").alias("n"))

    def shown(level: DataFrame, depth: int, cell: bool, keys: list[str]) -> DataFrame:
        absent = [F.lit(None).cast("string").alias(k) if k not in keys else F.col(k) for k in [*rows, *cols]]
        return level.select(F.lit(depth).alias("depth"), F.lit(cell).alias("cell"), *absent, x, "n")

    out, finer = None, counted
    for depth in range(len(rows), -1, -1):
        keys = [*rows[:depth], *cols]
        finer = add(finer, keys)
        levels = [shown(finer, depth, bool(cols), keys)]
        if cols:
            levels.append(shown(add(finer, rows[:depth]), depth, False, rows[:depth]))
        for level in levels:
            out = level if out is None else out.unionByName(level)
    return out


def _medians(counts: DataFrame, keys: list[str], x: str, name: str, few: bool) -> DataFrame:
    if not few:
        return quantiles_of_counts(counts, keys, x, "n", {name: 0.5})
    upto = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    middle = [F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1]  # one place where the number is odd
    return placed.groupBy(*keys).agg((sum(F.min(F.when(F.col("_upto") >= m, F.col(x))) for m in middle) / 2).alias(name))


def _aggregate(reduced: DataFrame, rows: list[str], cols: list[str], values: list) -> DataFrame:
    keys = [*rows, *cols]
    final, outs = [F.sum("n").alias("n")], []
    for i, (_, agg) in enumerate(values, start=1):
        v = f"v{i}"
        if agg in ("sum", "mean"):
            final += [F.sum(f"s{i}").alias(f"s{i}"), F.sum(f"k{i}").alias(f"k{i}")]
            outs.append((F.col(f"s{i}") if agg == "sum" else F.try_divide(F.col(f"s{i}"), F.col(f"k{i}"))).alias(v))
        elif agg in ("min", "max"):
            final.append((F.min if agg == "min" else F.max)(f"s{i}").alias(f"s{i}"))
            outs.append(F.col(f"s{i}").alias(v))
        elif agg == "count":
            outs.append(F.col("n").cast("double").alias(v))
    out = _leveled(reduced.where("_j = 0"), rows, cols, [], final).select("depth", "cell", *keys, "n", *outs)
    several = [(i, agg) for i, (_, agg) in enumerate(values, start=1) if agg in ("count_distinct", "median")]
    medians = [i for i, agg in several if agg == "median"]
    few = reduced.where(F.col("_j").isin(medians)).groupBy("_j").agg(F.count_distinct("_d").alias("k")).collect() if medians else []  # a row per column
    few = {r["_j"] for r in few if r["k"] <= WINDOW_VALUES}
    for i, agg in several:
        x = "_d" if agg == "median" else "_s"
        levels = _rolled_up(reduced.where(F.col("_j") == i).select(*keys, x, "n"), rows, cols, x)
        if agg == "median":
            found = _medians(levels, ["depth", "cell", *keys], x, f"v{i}", i in few)
        else:
            found = levels.groupBy("depth", "cell", *keys).agg(F.count(F.lit(1)).cast("double").alias(f"v{i}"))
        joined = out.alias("a").join(found.alias("b"), _same(["depth", "cell", *keys]), "left")
        value = F.coalesce(F.col(f"b.v{i}"), F.lit(0.0)) if agg == "count_distinct" else F.col(f"b.v{i}")
        out = joined.select("a.*", value.alias(f"v{i}"))
    return out.select("depth", "cell", *keys, "n", *[f"v{i}" for i in range(1, len(values) + 1)])


def _fold(reduced: DataFrame, cols: list[str], view: View) -> DataFrame:
    """Keep the ``max_columns - 1`` columns of largest absolute first total; the rest become one column."""
    most = view.max_columns
    first = F.col("v1") if view.values else F.col("n")
    labels = [k for c in cols for k in label_keys(F.col(c))]
    by_size = [F.isnull(first), F.desc(F.abs(first)), *labels]
    totals = _aggregate(reduced, [], cols, view.values[:1]).where("cell")
    largest = totals.orderBy(*by_size).limit(most + 1)  # windows and broadcast over max_columns + 1 rows at most
    whole = Window.partitionBy(F.lit(0))
    kept = largest.withColumns({"_at": F.row_number().over(whole.orderBy(*by_size)), "_all": F.count(F.lit(1)).over(whole)}).where(
        (F.col("_at") < most) | (F.col("_all") <= most)).select(*cols, F.lit(True).alias("_kept"))
    marked = reduced.alias("a").join(F.broadcast(kept).alias("b"), _same(cols), "left").select("a.*", "b._kept")
    return marked.withColumns({
        c: F.when(F.col("_kept"), F.col(c)).otherwise(F.lit(OTHER) if i == 0 else F.lit(None).cast("string"))
        for i, c in enumerate(cols)
    }).drop("_kept")


def pivot(df: DataFrame, view: View) -> DataFrame:
    """The long result: ``depth, cell, r1.., c1.., n, v1..``; cells that have no row are absent, never 0.

    ``depth`` = number of row keys (0 is the totals row), ``cell`` = whether the row belongs to a column
    (false: the total over columns).
    """
    check_view(df, view)
    keyed, rows, cols = _keyed(df, view)
    reduced = _reduced(keyed, [*rows, *cols], view.values)
    if view.max_columns is not None and cols:
        reduced = _fold(reduced, cols, view)
    return shares(_aggregate(reduced, rows, cols, view.values), rows, cols, view)


def shares(result: DataFrame, rows: list[str], cols: list[str], view: View) -> DataFrame:
    """Divide by the grand, row or column total; NULL when the whole is 0 or NULL."""
    names = [f"v{i}" for i in range(1, len(view.values) + 1)]
    if view.show_as == "value" or not names:
        return result
    result = cut(result)
    top = result.where(F.col("depth") == 0)  # the totals that everything is divided by are rows of the result
    grand = top.where(~F.col("cell"))
    of_grand = {v: ratio(F.col(v), grand.select(v).scalar()) for v in names}
    if view.show_as == "share_of_total":
        return result.withColumns(of_grand)
    if view.show_as == "share_of_row":
        totals = result.where(~F.col("cell")).select("depth", *rows, *[F.col(v).alias(f"w{v}") for v in names])
        joined = result.alias("a").join(totals.alias("b"), _same(["depth", *rows]), "left")
        keep = [c for c in result.columns if c not in names]
        return joined.select(*[f"a.{c}" for c in keep], *[ratio(F.col(f"a.{v}"), F.col(f"b.w{v}")).alias(v) for v in names])
    totals = top.where("cell").select(*cols, *[F.col(v).alias(f"w{v}") for v in names])
    joined = result.alias("a").join(totals.alias("b"), _same(cols) & F.col("a.cell"), "left")
    keep = [c for c in result.columns if c not in names]
    return joined.select(
        *[f"a.{c}" for c in keep],
        *[F.when(F.col("a.cell"), ratio(F.col(f"a.{v}"), F.col(f"b.w{v}")))
          .otherwise(ratio(F.col(f"a.{v}"), grand.select(v).scalar())).alias(v) for v in names],
    )


def ordered(result: DataFrame, n_rows: int, by: str = "label", descending: bool = False,
            column: tuple | None = None) -> DataFrame:
    """Row totals and subtotals in display order, as one distributed sort.

    Children follow their parent, ordered by label, by first value, or by one column's first value; blanks
    and the folded label stay last in either direction.
    """
    if by not in ("label", "value", "column"):
        raise ValueError(f"rows are ordered by label, value or column, not by {by!r}")
    rows = [f"r{i + 1}" for i in range(n_rows)]
    out = result.where(~F.col("cell"))
    if by == "column":
        if column is None:
            raise ValueError("which column orders the rows? its key is missing")
        source = result.where("cell")
        for i, part in enumerate(column):
            source = source.where(F.col(f"c{i + 1}").eqNullSafe(F.lit(part)))
    else:
        source = out
    keys: list[Column] = []
    for d in range(1, n_rows + 1):
        label = F.col(f"r{d}")
        keys.append(F.when(F.col("depth") < d, 0).otherwise(1))  # a group's own row before its children
        if by != "label":
            metric = source.where(F.col("depth") == d).select(*rows[:d], F.col("v1").alias(f"m{d}"))
            joined = out.alias("a").join(metric.alias("b"), _same(rows[:d]) & (F.col("a.depth") >= d), "left")
            out = joined.select("a.*", F.col(f"b.m{d}"))
            m = F.col(f"m{d}")
            keys += [F.isnull(m), F.desc(m) if descending else F.asc(m), *label_keys(label)]
        else:
            last, week, text = label_keys(label)
            keys += [last, F.desc(week) if descending else week, F.desc(text) if descending else text]
    return out.orderBy(*keys).drop(*[f"m{d}" for d in range(1, n_rows + 1)])


def wide(result: DataFrame, n_rows: int, n_cols: int, value: str = "v1") -> DataFrame:
    """Display form: one column per column key (at most as many as the view shows) and ``Total``."""
    rows = [f"r{i + 1}" for i in range(n_rows)]
    name = F.when(F.col("cell"), F.concat_ws(" / ", *[F.coalesce(f"c{i + 1}", F.lit("(blank)")) for i in range(n_cols)]))
    named = result.withColumn("_c", F.coalesce(name, F.lit("Total")))
    return named.groupBy("depth", *rows).pivot("_c").agg(F.first(value))
