"""CSV records of splittable files, quoted cells across lines included.

A file is read as lines, split by split.  A line is inside a quoted cell if an odd number of quotes stands before it
in its file.  Each split contributes one bit, whether its quotes are odd in number; the prefix of these bits over a
file's splits (a row each) tells every split how it begins, and a running count tells its lines.  Only the lines of
records that span lines are brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut

PLACE = ["_file", "_block", "_line"]


def records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (text) with its place: ``_file``, ``_block`` (start of the split) and ``_line`` in it.  Each file's
    header is left out, and so are blank lines.  A quote that is never closed makes one record of the rest of its file.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value")  # ascending inside a split, which one task reads
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    odd = (quotes % 2).cast("int")
    blocks = cut(raw.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.sum(odd).alias("_odd")))
    lines = raw.join(blocks.select("_file", "_block", "_first"), ["_file", "_block"]).select(
        "_file", "_block", (F.col("_id") - F.col("_first")).alias("_line"), "value", odd.alias("_q"))
    header = (F.col("_block") == 0) & (F.col("_line") == 0)
    plain = F.regexp_replace("record", "\r$", "")
    if blocks.where("_odd > 0").isEmpty():  # every quote closes on its line
        whole = lines.where(~header).select(*PLACE, F.col("value").alias("record"))
        return whole.select(*PLACE, plain.alias("record")).where("trim(record) <> ''")
    ahead = Window.unboundedPreceding, -1
    begins = blocks.select("_file", "_block", F.coalesce(F.sum("_odd").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(*ahead)), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_file", "_block").orderBy("_line")  # a split's lines
    seen = F.col("_before") + F.coalesce(F.sum("_q").over(here.rowsBetween(*ahead)), F.lit(0))
    marked = lines.join(begins, ["_file", "_block"]).withColumns({"_inside": seen % 2 == 1, "_open": (seen + F.col("_q")) % 2 == 1})
    alone = marked.where(~F.col("_inside") & ~F.col("_open") & ~header).select(*PLACE, F.col("value").alias("record"))
    parts = marked.where(F.col("_inside") | F.col("_open"))
    start = F.when(~F.col("_inside"), F.struct("_block", "_line"))
    local = parts.withColumn("_start", F.last(start, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    # a record that goes on from an earlier split: the last start of the splits before
    lasts = parts.groupBy("_file", "_block").agg(F.max(start).alias("_last"))
    carried = lasts.select("_file", "_block", F.last("_last", ignorenulls=True).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(*ahead)).alias("_carried"))
    joined = local.join(carried, ["_file", "_block"]).withColumn("_of", F.coalesce("_start", "_carried"))
    stitched = joined.groupBy("_file", "_of").agg(F.array_sort(F.collect_list(F.struct("_block", "_line", "value"))).alias("l")).select(
        "_file", F.col("_of._block").alias("_block"), F.col("_of._line").alias("_line"), F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("record"))
    stitched = stitched.where(~header)
    return alone.unionByName(stitched).select(*PLACE, plain.alias("record")).where("trim(record) <> ''")


def cells(rows: DataFrame, names: list[str], delimiter: str) -> DataFrame:
    """``rows`` of ``records`` with ``c0``, ``c1`` .. as text and ``_bad`` (not NULL for a row of another width)."""
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "_bad string"])
    parsed = F.from_csv("record", schema, {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select(*PLACE, parsed.alias("_r")).select(*PLACE, "_r.*")
