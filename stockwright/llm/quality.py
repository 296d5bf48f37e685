"""Quality rules with thresholds that adapt to language and source.

Every text is measured once.  Each measure is put into logarithmic bins (a value's bin tells it within one per cent),
and the counts per language, source and bin are the quantile sketch: two sketches merge by adding counts, so tasks
pre-aggregate, and the sketch of a language is the sum of those of its sources.  Fences follow from a sketch's
quartiles; they are joined to the measures by language and source, and documents outside them go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, cut, narrow

#: A bin holds values within a factor of (1 + ACCURACY) / (1 - ACCURACY) of each other.
ACCURACY = 0.01
#: Fences lie this many interquartile ranges beyond the quartiles, and at least the rule's margin.
REACH = 3.0
#: A sketch of fewer documents gives way to its language's, and this one to that of all documents.
LEAST_DOCUMENTS = 50
#: Rule: margin that a fence keeps from its quartile, and whether small values fail too.
RULES = {"word_length": (3.0, True), "symbols_per_word": (0.25, False), "repeated_share": (0.14, False), "repeated_lines": (0.04, False)}

_LOG = "ln(1.01 / 0.99)"


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the six base measures of every whole text (NULL: no word).

    Words found twice or more in windows of five: the windows' hashes are sorted with their places inside the row, and
    what the repeated ones cover is added up from one place to the next; no row is exploded.
    """
    df = narrow(docs, doc_id=id, lang=lang, source=source, text=text)
    whole = df.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    words = whole.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.struct(
        F.xxhash64(*[F.get("words", i + k) for k in range(5)]).alias("h"), i.alias("i")))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    measured = words.select(
        "doc_id", "lang", "source", n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.when(F.instr("text", "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("bigint").alias("n_dup_lines"),
        windows.alias("w"),
    )
    hashes = F.transform("w", lambda x: x["h"])
    # places of repeated windows only, ascending; most texts have none and stop at the distinct count
    again = measured.select("*", F.when(F.size(F.array_distinct(hashes)) < F.size("w"), F.array_sort("w")).alias("s")).drop("w")
    twin = F.filter(F.transform("s", lambda x, k: F.when(
        (F.get("s", k + 1)["h"] == x["h"]) | (F.get("s", k - 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
    placed = again.select("*", F.array_sort(twin).alias("p")).drop("s")
    steps = F.transform("p", lambda x, k: F.when(k < F.size("p") - 1, F.least(F.get("p", k + 1) - x, F.lit(5))).otherwise(5))
    total = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return placed.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(total, F.lit(0)).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _values() -> dict[str, Column]:
    n = F.col("n_words")
    return {"word_length": F.try_divide("word_chars", n), "symbols_per_word": F.try_divide("n_symbols", n), "repeated_share": F.try_divide("n_repeat_words", n),
            "repeated_lines": F.try_divide("n_dup_lines", n)}


def sketches(measured: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``rule``, ``bin``, ``n``: counts per logarithmic bin (NULL bin: zero) of texts that pass the base."""
    rows = measured.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.when(v > 0, F.ceil(F.ln(v) / F.expr(_LOG))).cast("int").alias("bin")) for rule, v in _values().items()
    ])).alias("x"))
    return rows.groupBy("lang", "source", "x.rule", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``rule``, ``low``, ``high``: by the group's own sketch, its language's, or that of all.

    Sketches are small: at most about 70,000 bins would hold every double, and a group has as many rows as it has bins.
    """
    merged = sketch.select(F.lit(0).alias("level"), "lang", "source", "rule", "bin", "n").unionByName(
        sketch.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "rule", "bin", "n")
    ).unionByName(
        sketch.groupBy("rule", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "rule", "bin", "n")
    )
    group = Window.partitionBy("level", "lang", "source", "rule")
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.exp(F.col("bin") * F.expr(_LOG)) / F.lit(1 + (1 + ACCURACY) / (1 - ACCURACY)))
    ranked = merged.select("*", value.alias("v"), F.sum("n").over(group).alias("all"), F.sum("n").over(group.orderBy(F.col("bin").asc_nulls_first())).alias("upto"))
    quartile = lambda p: F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("v")))
    found = ranked.groupBy("level", "lang", "source", "rule").agg(F.max("all").alias("docs"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    margin = F.greatest(F.lit(REACH) * (F.col("q3") - F.col("q1")), F.element_at(F.create_map(*[x for k, (m, _) in RULES.items() for x in (F.lit(k), F.lit(m))]), F.col("rule")))
    both = F.element_at(F.create_map(*[x for k, (_, b) in RULES.items() for x in (F.lit(k), F.lit(b))]), F.col("rule"))
    fenced = found.select("level", "lang", "source", "rule", "docs", F.when(both, F.col("q1") - margin).otherwise(-1.0).alias("low"), (F.col("q3") + margin).alias("high"))
    own, by_lang, by_all = (fenced.where(F.col("level") == k).alias(f"f{k}") for k in range(3))
    joined = own.join(by_lang, F.col("f0.lang").eqNullSafe(F.col("f1.lang")) & (F.col("f0.rule") == F.col("f1.rule"))).join(by_all, F.col("f0.rule") == F.col("f2.rule"))
    pick = lambda c: F.when(F.col("f0.docs") >= LEAST_DOCUMENTS, F.col(f"f0.{c}")).when(F.col("f1.docs") >= LEAST_DOCUMENTS, F.col(f"f1.{c}")).otherwise(F.col(f"f2.{c}"))
    return joined.select("f0.lang", "f0.source", "f0.rule", pick("low").alias("low"), pick("high").alias("high"))


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: the base measures, ``base_failed`` and ``kept``.

    A document is kept if it passes the base and all its measures lie inside the fences of its language and source.
    NULL texts have no word and fail; NULL languages and sources are groups of their own; repeated rows are each judged.
    """
    measured = cut(measures(docs, id, text, lang, source))
    limits = fences(sketches(measured))
    wide = cut(limits.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{c}_{r}") for r in RULES for c in ("low", "high")
    ]).withColumnsRenamed({"lang": "to_lang", "source": "to_source"}))
    inside = F.lit(True)
    for rule, v in _values().items():
        inside = inside & (v >= F.col(f"low_{rule}")) & (v <= F.col(f"high_{rule}"))
    found = measured.join(wide, measured.lang.eqNullSafe(wide.to_lang) & measured.source.eqNullSafe(wide.to_source), "left")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))


#: The same in DuckDB.
SQL = r"""
with base as (
  select doc_id, lang, source, coalesce(text, '') as t, row_number() over () as rid from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from base),
win as (
  select rid, i, count(*) over (partition by rid, list_slice(w, i, i + 4)) as c
  from words, unnest(range(1, len(w) - 3)) as r(i) where len(w) >= 5),
cover as (
  select rid, sum(least(5, coalesce(nxt - i, 5))) as n from (
    select rid, i, lead(i) over (partition by rid order by i) as nxt from win where c > 1) group by rid),
lines as (
  select rid, count(*) - count(distinct l) as n from (select rid, unnest(string_split(t, chr(10))) as l from base)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
m as (
  select doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(cover.n, 0) as bigint) as n_repeat_words
  from words left join lines using (rid) left join cover using (rid)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
long as (
  select lang, source, rule, case when v > 0 then cast(ceil(ln(v) / ln(1.01 / 0.99)) as int) end as bin from (
    select lang, source, unnest(['word_length', 'symbols_per_word', 'repeated_share', 'repeated_lines']) as rule,
      unnest([cast(word_chars as double) / n_words, cast(n_symbols as double) / n_words, cast(n_repeat_words as double) / n_words, cast(n_dup_lines as double) / n_words]) as v
    from judged where not base_failed)),
sk as (
  select 0 as level, lang, source, rule, bin, count(*) as n from long group by all
  union all select 1, lang, null, rule, bin, count(*) from long group by lang, rule, bin
  union all select 2, null, null, rule, bin, count(*) from long group by rule, bin),
ranked as (
  select *, case when bin is null then 0.0::double else 2 * exp(bin * ln(1.01 / 0.99)) / (1 + cast(1.01 as double) / 0.99) end as v,
    sum(n) over (partition by level, lang, source, rule) as al,
    sum(n) over (partition by level, lang, source, rule order by bin nulls first) as upto from sk),
q as (
  select level, lang, source, rule, max(al) as docs, min(case when upto >= al * 0.25 then v end) as q1, min(case when upto >= al * 0.75 then v end) as q3
  from ranked group by level, lang, source, rule),
f as (
  select *, case when rule = 'word_length' then q1 - mar else -1 end as low, q3 + mar as high from (
    select *, greatest(3 * (q3 - q1), case rule when 'word_length' then 3.0 when 'symbols_per_word' then 0.25 when 'repeated_share' then 0.14 else 0.04 end) as mar from q)),
own as (
  select a.lang, a.source, a.rule,
    case when a.docs >= 50 then a.low when b.docs >= 50 then b.low else c.low end as low,
    case when a.docs >= 50 then a.high when b.docs >= 50 then b.high else c.high end as high
  from f a join f b on b.level = 1 and b.lang is not distinct from a.lang and b.rule = a.rule join f c on c.level = 2 and c.rule = a.rule
  where a.level = 0),
wide as (
  select lang, source, max(case when rule = 'word_length' then low end) as l1, max(case when rule = 'word_length' then high end) as h1,
    max(case when rule = 'symbols_per_word' then high end) as h2, max(case when rule = 'repeated_share' then high end) as h3, max(case when rule = 'repeated_lines' then high end) as h4
  from own group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(cast(word_chars as double) / n_words between l1 and h1 and cast(n_symbols as double) / n_words <= h2
    and cast(n_repeat_words as double) / n_words <= h3 and cast(n_dup_lines as double) / n_words <= h4, false) as kept
from judged j left join wide x on x.lang is not distinct from j.lang and x.source is not distinct from j.source
"""
