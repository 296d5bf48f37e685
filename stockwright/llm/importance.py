"""Importance resampling towards a target distribution, by hashed n-gram features of deduplicated segments.

Words hold no line break, so texts are cut into lines at their line breaks.  A feature (a run of one to three words)
lies inside one line or crosses a line's end.  Lines repeat much more often than texts do: Spark counts how often each
distinct line occurs, the features inside a line are hashed once and counted as often as the line occurs, and only the
few features that cross lines are taken from the texts themselves.  In the second half the same table serves again: a
line's gain is summed once and goes to every text that holds it.

A line with at least ``SHARE`` of all line occurrences is looked up by broadcast (there are at most ``1 / SHARE``), so no
task gathers a hot line's places; all other lines are joined by digest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranks import running_totals
from .common import narrow, slices, stored

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SHARE = 1e-5
#: Distinct lines that a task holds before it passes on its counts, and their bytes.
HELD_LINES = 200_000
HELD_BYTES = 48 << 20

_BREAK = 10
#: A-Z become a-z, all other ASCII characters that are no letter or digit become spaces, line breaks stay.
_LETTERS = bytes(b if b >= 0x80 or b == _BREAK or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def lines_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of each line that has any."""
    for part in _pieces(text):
        for line in part.translate(_LETTERS).split(b"\n"):
            if words := line.split():
                yield words


def _pieces(text: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes, cut at line breaks."""
    at = 0
    while len(text) - at > size and (end := text.find(b"\n", at + size)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


def inner_codes(words: list[bytes]) -> list[int]:
    """crc32 of every run of one to ``RUN`` words, chained from each run to the one that is a word longer."""
    spaced = [b" " + w for w in words]
    codes = out = list(map(crc32, words))
    for n in range(1, min(RUN, len(words))):
        codes = list(map(crc32, spaced[n:], codes))
        out = out + codes
    return out


def crossing_codes(before: list[bytes], words: list[bytes]) -> list[int]:
    """crc32 of the runs that begin in ``before``, the last words of earlier lines, and end in ``words``."""
    out, spaced = [], [b" " + w for w in words[: RUN - 1]]
    for start in range(len(before)):
        code = crc32(b" ".join(before[start:]))
        for w in spaced[: RUN - len(before) + start]:
            code = crc32(w, code)
            out.append(code)
    return out


def _segments(text: bytes) -> tuple[Counter[bytes], list[int], int]:
    """Lines as joined words with their numbers, codes of crossing features, number of words."""
    lines: Counter[bytes] = Counter()
    crossing, words, before = [], 0, []
    for line in lines_of(text):
        words += len(line)
        lines[b" ".join(line)] += 1
        if before:
            crossing += crossing_codes(before, line)
        before = (before + line[1 - RUN :])[1 - RUN :]
    return lines, crossing, words


def _string(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def line_counts(texts: DataFrame) -> DataFrame:
    """``line`` (its words, joined) and ``n``, how often it occurs; the line NULL holds crossing features as ``cells``.

    Tasks count in bounded tables before the shuffle, so a hot line arrives once per task and table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        crossing, held = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                lines, codes, _ = _segments(t or b"")
                seen.update(lines)
                held += sum(map(len, lines))
                if codes:
                    crossing += np.bincount(np.array(codes, np.int64) % BUCKETS, minlength=BUCKETS)
                if len(seen) > HELD_LINES or held > HELD_BYTES:
                    yield _counted(seen)
                    seen, held = Counter(), 0
        yield _counted(seen)
        there = np.flatnonzero(crossing)
        if len(there):
            yield _counted({}, there, crossing[there])

    return texts.select("text").mapInArrow(run, "line string, bucket int, n bigint").groupBy("line", "bucket").agg(F.sum("n").alias("n"))


def _counted(lines: dict[bytes, int], bucket=(), n=()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([_string(list(lines)), pa.nulls(len(bucket), pa.string())]),
         pa.concat_arrays([pa.nulls(len(lines), pa.int32()), pa.array(np.asarray(bucket, np.int32))]),
         pa.array([*lines.values(), *map(int, n)], pa.int64())], ["line", "bucket", "n"])


def line_table(counts: DataFrame) -> DataFrame:
    """``digest``, ``n``, ``codes``: the buckets of all features inside each distinct line, two bytes each.

    Rows without a digest hold the features that cross lines: their bucket in ``codes``, their number in ``n``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, 4 << 20)):
            digest, codes = [], []
            for line, bucket in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                if line is None:
                    digest.append(None)
                    codes.append(np.array([bucket], np.uint16).tobytes())
                else:
                    digest.append(xxhash.xxh3_128_digest(line))
                    codes.append((np.array(inner_codes(line.split(b" ")), np.int64) % BUCKETS).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), b.column(2), pa.array(codes, pa.binary())], ["digest", "n", "codes"])

    return counts.select("line", "bucket", "n").mapInArrow(run, "digest binary, n bigint, codes binary")


def bucket_counts(table: DataFrame) -> np.ndarray:
    """Features of the whole corpus in each bucket: each line's, as often as the line occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            codes = b.column(1).to_pylist()
            n = np.asarray(b.column(0))
            flat = np.frombuffer(b"".join(codes), np.uint16)
            times = np.repeat(n, [len(c) // 2 for c in codes])
            # by multiplicity, so that bincount keeps to whole numbers
            once = times == 1
            total += np.bincount(flat[once], minlength=BUCKETS)
            np.add.at(total, flat[~once], times[~once])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": there.astype(np.int32), "n": total[there]})

    found = table.select("n", "codes").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of a bucket's shares in the target and in the corpus."""
    t, s = target.astype(np.float64), source.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(id_column: str = "doc_id", seed: int = SEED) -> Column:
    """1000 times a Gumbel draw, rounded down, from a digest of the id; a NULL id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("bigint")


@lru_cache(maxsize=2)
def _hot(key) -> dict[bytes, tuple[int, int]]:
    digests, weights, features = key.value
    return dict(zip(digests, zip(weights, features)))


class _Key:
    """A broadcast that a worker's cache can tell by its number."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.number = broadcast, number

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self) -> int:
        return self.number

    def __eq__(self, other) -> bool:
        return isinstance(other, _Key) and self.number == other.number


def weigh(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``: the sum of the gains of all features of every whole text.

    NULL and empty texts, and texts without a word, have no features and weight 0.  Repeated rows each count and are each
    weighed.  An empty target or corpus counts no feature: the smoothing alone is left.
    """
    spark = docs.sparkSession
    df = narrow(docs, doc_id=id, text=text)
    table = stored(line_table(line_counts(df)), "importance-lines")
    wanted = bucket_counts(line_table(line_counts(narrow(target, text=target_text))))
    gain = spark.sparkContext.broadcast(gains(wanted, bucket_counts(table)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(2).to_pylist()
            size = np.array([len(c) // 2 for c in codes], np.int64)
            upto = np.r_[0, np.cumsum(gain.value[np.frombuffer(b"".join(codes), np.uint16)])]
            end = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(upto[end] - upto[end - size]), pa.array(size)], ["digest", "n", "weight", "features"])

    lines = table.where("digest is not null").select("digest", "n", "codes").mapInArrow(summed, "digest binary, n bigint, weight bigint, features bigint")
    total = table.where("digest is not null").agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") >= F.greatest(F.lit(2), F.lit(total) * SHARE)
    often = lines.where(is_hot).select("digest", "weight", "features").toArrow()
    hot = _Key(spark.sparkContext.broadcast(tuple(often.column(i).to_pylist() for i in range(3))), hash((spark.sparkContext.applicationId, table.inputFiles()[0] if total else "")))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gained = _hot(hot), gain.value
        row = TaskContext.get().partitionId() << 40
        for b in (x for whole in batches for x in slices(whole)):
            out = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                lines, crossing, words = _segments(t or b"")
                weight = int(gained[np.array(crossing, np.int64) % BUCKETS].sum()) if crossing else 0
                features, others, times = len(crossing), [], []
                for line, n in lines.items():
                    digest = xxhash.xxh3_128_digest(line)
                    if (found := known.get(digest)) is None:
                        others.append(digest)
                        times.append(n)
                    else:
                        weight, features = weight + n * found[0], features + n * found[1]
                out.append((row, words, features, weight, others, times))
                row += 1
            c = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), b.column(0), *[pa.array(c[i], pa.int64()) for i in (1, 2, 3)], pa.array(c[4], pa.list_(pa.binary())), pa.array(c[5], pa.list_(pa.int32()))],
                ["row", "doc_id", "n_words", "n_features", "weight", "lines", "times"])

    found = stored(df.mapInArrow(run, f"row bigint, doc_id {kind}, n_words bigint, n_features bigint, weight bigint, lines array<binary>, times array<int>"), "importance-texts")
    pairs = found.select("row", F.explode(F.arrays_zip("lines", "times")).alias("x")).select("row", F.col("x.lines").alias("digest"), F.col("x.times").alias("times"))
    looked = pairs.join(lines.where(~is_hot), "digest").groupBy("row").agg(
        F.sum(F.col("times") * F.col("weight")).alias("more"), F.sum(F.col("times") * F.col("features")).alias("others"))
    return found.drop("lines", "times").join(looked, "row", "left").select(
        "doc_id", "n_words", (F.col("n_features") + F.coalesce("others", F.lit(0))).alias("n_features"), (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_features``, ``weight``, ``score`` (weight and noise) and ``rank``.

    Of the N documents with at least ``LEAST_WORDS`` words, the floor(percent * N / 100) of highest score are drawn; they
    are numbered from 1 in falling order of score, ties by smaller id (NULL first, then weight and features), the others'
    rank is NULL.  Rows equal in all of these may take their ranks in any order.  An empty table gives no row.
    """
    weighed = stored(weigh(docs, target, id, text, target_text).withColumn("score", F.col("weight") + noise()), "importance-weights")
    able = F.col("n_words") >= LEAST_WORDS
    n = percent * weighed.where(able).count() // 100
    # numbers of higher scores by running totals over score ranges; scores that end below the n-th place are left out
    each = weighed.where(able).groupBy((-F.col("score")).alias("low")).agg(F.count(F.lit(1)).alias("n"))
    reached = running_totals(each, [], "low", ["n"]).where(F.col("n_before") < n).select((-F.col("low")).alias("_score"), F.col("n_before").alias("_before"))
    # equal rows are one row with a number until the places among equal scores are known
    equal = weighed.groupBy(able.alias("_able"), "doc_id", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("_rows"))
    placed = equal.join(reached, F.col("_able") & (F.col("score") == F.col("_score")), "left")
    among = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.where("_before is not null").withColumn("_first", F.col("_before") + F.coalesce(F.sum("_rows").over(among), F.lit(0)) + 1)
    both = held.unionByName(placed.where("_before is null").withColumn("_first", F.lit(None).cast("bigint")))
    place = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rows") - 1)).alias("_at")
    number = F.col("_first") + F.col("_at")
    return both.select("doc_id", "n_features", "weight", "score", "_first", place).select(
        "doc_id", "n_features", "weight", "score", F.when(number <= n, number).alias("rank"))


#: The same over tables ``documents`` and ``benchmark``; crc32 by its table, itself made from the polynomial.
SQL = r"""
with docs as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
wanted as (
  select 0 as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
starts as (select r, w, unnest(range(1, len(w) + 1)) as i from (select r, w from docs union all select r, w from wanted)),
runs as (select r, unnest([array_to_string(w[i:i + k], ' ') for k in range(0, least(3, len(w) - i + 1))]) as f from starts),
counted as (select r, f, count(*) as n from runs group by r, f),
crc as (select [list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) for i in range(256)] as t),
named as (select f, hex(encode(f)) as x from (select distinct f from counted)),
coded as (
  select f, xor(list_reduce([('0x' || x[p:p + 1])::bigint for p in range(1, len(x), 2)], lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 as bucket
  from named, crc),
cells as (select r, bucket, sum(n)::bigint as n from counted join coded using (f) group by r, bucket),
sums as (select bucket, sum(n) filter (r > 0) as s, sum(n) filter (r = 0) as t from cells group by bucket),
alls as (select coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from sums),
gain as (
  select bucket, floor(1000 * ln((coalesce(a.t, 0) + 1)::double * (b.s + 10000)::double / ((coalesce(a.s, 0) + 1)::double * (b.t + 10000)::double)))::bigint as g
  from sums a, alls b),
weights as (select r, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from cells join gain using (bucket) group by r),
scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5)::double / 4294967296)))::bigint as score
  from docs left join weights using (r)),
placed as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first, weight, n_features) as place,
    count(*) filter (n_words >= 20) over () as able
  from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * able // 100 then place end as rank
from placed
"""
