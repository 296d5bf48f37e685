"""Mixing sources to target weights by a curriculum that changes over training.

Sizes are words.  Targets share the words of all documents by the sources' weights, up to a multiple of each source's
size (water filling).  A source's documents stand in a fixed order, repeated as often as needed; the words before a
document are its cumulative demand.  Each source's weight is a schedule over training time 0 .. 1; its integral,
scaled to the target, says how much of the source is wanted up to a time, and inverting it gives each document the
time at which its turn comes.  Sorting all sources by that time gives the training order.

Orders inside a source come from running sums over hash ranges of bounded size, so a source that owns a third of all
rows is dealt over as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, cut, narrow

#: A source takes at most this many times its size.
MOST = 3
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Schedules of the sources in the same order: (time, weight) points joined by straight lines, from time 0 to 1.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Documents of one hash range, which a task sums in order.
RANGE_ROWS = 1_000


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``place`` (of its name) and ``target``; one row per source.

    ``sizes`` has (source, source_size).  With total T and weights w, targets are min(MOST * size, level * w) for the
    level at which they add up to T.  Sources by size over weight: those before the level are at their limit.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.col("place"), F.lit(len(WEIGHTS))) + 1)
    # windows over sources only: a row of three numbers each
    placed = sizes.withColumn("place", F.row_number().over(everything) - 1).withColumn("weight", weight)
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    run = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.col("total") - MOST * (F.col("s_upto") - F.col("source_size"))) / (F.col("w_all") - F.col("w_upto") + F.col("weight"))
    filled = placed.select("*", F.sum("source_size").over(whole).alias("total"), F.sum("weight").over(whole).alias("w_all"),
                           F.sum("source_size").over(run).alias("s_upto"), F.sum("weight").over(run).alias("w_upto"))
    # the first source whose share at its level stays under its limit sets the level of all that follow
    leveled = filled.withColumn("level", level)
    found = leveled.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= MOST * F.col("source_size"), F.struct(
        F.col("source_size") / F.col("weight"), "place", "level"))).over(whole)["level"])
    return found.select("source", "source_size", "place",
                        F.least(F.col("level") * F.col("weight"), (MOST * F.col("source_size")).cast("double")).alias("target"))


def _time(fraction: Column, place: Column) -> Column:
    """The training time at which ``fraction`` of a source's demand has been met, by its schedule's inverse integral."""
    out = None
    for k, points in enumerate(SCHEDULES):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:])]
        all_, before, piece = sum(areas), 0.0, None
        for ((t0, w0), (t1, w1)), area in zip(zip(points, points[1:]), areas):
            wanted = fraction * F.lit(all_) - F.lit(before)  # area inside this piece
            slope = (w1 - w0) / (t1 - t0)
            inside = wanted / F.lit(w0) if slope == 0 else 2 * wanted / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * wanted, F.lit(0.0))))
            time = F.lit(t0) + inside
            piece = F.when(wanted <= area, time) if piece is None else piece.when(wanted <= area, time)
            before += area
        piece = piece.otherwise(1.0)
        out = F.when(place % len(SCHEDULES) == k, piece) if out is None else out.when(place % len(SCHEDULES) == k, piece)
    return out


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and
    ``position`` (the training time of its first words; NULL if none are taken).

    Documents of a source follow each other by the md5 of their id, then id, then size.  The last document that a
    source's target reaches is taken in part, so a source's taken words are its target's whole words.  Sizes of NULL and empty
    texts are 0; they take nothing.  Rows that repeat an id are documents of their own.  A NULL source is the last one.
    An empty table gives no row.

    Rows come in training order: one range sort of all sources by position, ties by id, then size; what takes nothing
    comes last, in no order.
    """
    position = F.when(F.col("taken") > 0, _time(F.col("fraction"), F.col("place")))
    dealt = cut(_dealt(docs, id, text, source).select("doc_id", "size", "source_size", "target", "taken", position.alias("position")))
    # documents without a turn share one position: dealt over all ranges after the last turn
    late = F.coalesce("position", F.lit(2.0) + F.rand(0))
    return dealt.withColumn("_at", late).repartitionByRange("_at", "doc_id", "size").sortWithinPartitions("_at", "doc_id", "size").drop("_at")


def _dealt(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """``mix`` with ``fraction`` (of the source's demand before the document), ``lap`` (to its next copy) and ``place``."""
    df = narrow(docs, doc_id=id, source=source, text=text)
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = cut(df.select("doc_id", "source", n.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key")))
    rows, digits = sized.count(), 0
    while 16**digits * RANGE_ROWS < rows:
        digits += 1
    ranged = sized.withColumn("range", F.substring("key", 1, digits))
    sums = cut(ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    goal = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    before = _prefix(sums, digits // 2)
    offsets = cut(before.join(goal.withColumnRenamed("source", "goal_source"), before.source.eqNullSafe(F.col("goal_source"))).drop("goal_source")
                  .withColumnsRenamed({"source": "o_source", "range": "o_range"}))
    local = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ranged.withColumn("inside", F.coalesce(F.sum("size").over(local), F.lit(0)))
    joined = ordered.join(offsets, ordered.source.eqNullSafe(offsets.o_source) & (ordered.range == offsets.o_range))
    start, size = F.col("range_before") + F.col("inside"), F.col("size")
    words, whole = F.floor("target"), F.col("source_size")
    rounds = F.floor(words / F.greatest(whole, F.lit(1)))
    rest = words - rounds * whole
    taken = rounds * size + F.greatest(F.lit(0), F.least(size, rest - start))
    share = lambda c: F.when(F.col("target") > 0, c / F.col("target"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
                         share(start).alias("fraction"), share(whole).alias("lap"), "place")


def _prefix(sums: DataFrame, digits: int) -> DataFrame:
    """``source``, ``range``, ``range_before``: the words of the source's earlier ranges.

    In two steps, over groups of ranges with the same first ``digits`` and inside each group, so that neither sorts
    all ranges of a source.
    """
    grouped = sums.withColumn("group", F.substring("range", 1, digits))
    ahead = Window.unboundedPreceding, -1
    groups = grouped.groupBy("source", "group").agg(F.sum("range_size").alias("group_size")).select(
        F.col("source").alias("g_source"), F.col("group").alias("g_group"),
        F.coalesce(F.sum("group_size").over(Window.partitionBy("source").orderBy("group").rowsBetween(*ahead)), F.lit(0)).alias("group_before"))
    inside = F.coalesce(F.sum("range_size").over(Window.partitionBy("source", "group").orderBy("range").rowsBetween(*ahead)), F.lit(0))
    placed = grouped.select("source", "range", "group", inside.alias("inside"))
    return placed.join(groups, placed.source.eqNullSafe(groups.g_source) & (placed.group == groups.g_group)).select(
        "source", "range", (F.col("group_before") + F.col("inside")).alias("range_before"))


def arranged(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` (all columns), each as often as the mix takes it, in training order.

    A document's copies come one source size apart; the last, partial one is whole if half of it or more is taken.
    Rows that repeat id, size and source are dealt the turns of all of them one by one.
    """
    wanted = _dealt(docs, id, text, source)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + F.lit(0.5)).cast("int")
    words = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("bigint")
    held = docs.select(docs[id].alias("held_id"), docs[source].alias("held_source"), words.alias("words"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    turns = cut(wanted.where("size > 0").select("doc_id", "source", "size", times.alias("copies"), "fraction", "lap", "place"))
    key = ["doc_id", "source", "size"]
    rows = turns.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("copies").alias("copies"), F.min("fraction").alias("fraction"),
                                   F.max("lap").alias("lap"), F.min("place").alias("place"))
    same = lambda d: (held.held_id.eqNullSafe(d.doc_id) & held.held_source.eqNullSafe(d.source) & (held.words == d["size"]))
    single = rows.where("rows = 1 AND copies > 0")
    fields = ["held_id", "row", "fraction", "lap", "place", "copies"]
    found = held.join(single, same(single)).select(*fields)
    several = cut(rows.where("rows > 1 AND copies > 0").select(*key))
    if not several.isEmpty():
        turn = Window.partitionBy(*key).orderBy("fraction")
        dealt = turns.join(several.withColumnsRenamed({k: f"_{k}" for k in key}), F.col("doc_id").eqNullSafe(F.col("_doc_id"))
                           & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")), "left_semi")
        dealt = dealt.select("*", F.row_number().over(turn).alias("turn")).where("copies > 0")
        mine = Window.partitionBy("held_id", "held_source", "words").orderBy("row")
        numbered = held.join(several, same(several), "left_semi").select("*", F.row_number().over(mine).alias("mine"))
        found = found.unionByName(numbered.join(dealt, numbered.held_id.eqNullSafe(dealt.doc_id) & numbered.held_source.eqNullSafe(dealt.source)
                                                & (numbered.words == dealt["size"]) & (numbered.mine == dealt.turn)).select(*fields))
    copies = found.select("held_id", "row", "fraction", "lap", "place", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    at = _time(F.least(F.col("fraction") + F.col("copy") * F.col("lap"), F.lit(1.0)), F.col("place"))
    return copies.select("held_id", "row", at.alias("at")).repartitionByRange("at").sortWithinPartitions("at", "held_id").select("row.*")


#: The same in DuckDB.
SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
p as (select *, row_number() over (order by source nulls last) - 1 as place from s),
w as (select *, cast(place % 3 + 1 as double) as weight from p),
r as (
  select *, sum(source_size) over () as total, sum(weight) over () as w_all,
    sum(source_size) over (order by source_size / weight, place rows unbounded preceding) as s_upto,
    sum(weight) over (order by source_size / weight, place rows unbounded preceding) as w_upto from w),
l as (select *, cast(total - 3 * (s_upto - source_size) as double) / (w_all - w_upto + weight) as level from r),
v as (select arg_min(level, source_size / weight) as level from l where level * weight <= 3 * source_size),
t as (select l.source, l.source_size, l.place, least(v.level * weight, cast(3 * source_size as double)) as target from l, v),
o as (select d.*, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start from d),
j as (
  select o.*, t.source_size, t.target, t.place, floor(t.target) as words, floor(floor(t.target) / greatest(t.source_size, 1)) as rounds
  from o join t on o.source is not distinct from t.source),
k as (select *, cast(rounds * size + greatest(0, least(size, words - rounds * source_size - start)) as bigint) as taken, start / target as f from j)
select doc_id, size, source_size, target, taken, case when taken > 0 then round(case place % 3
    when 0 then 0.0 + f * 1.0
    when 1 then 0.0 + 2 * (f * 1.0) / (0.5 + sqrt(0.25 + 2 * 1.0 * (f * 1.0)))
    else case when f <= 0.625 then 0.0 + 2 * f / (1.5 + sqrt(greatest(2.25 + 2 * -1.0 * f, 0)))
      else 0.5 + 2 * (f - 0.625) / (1.0 + sqrt(greatest(1.0 + 2 * -1.0 * (f - 0.625), 0))) end end, 6) end as position
from k
"""
