"""Toxicity of texts: gradient-boosted trees over dense features, with isotonic calibration.

1.  The lexicon.  Spark counts in how many labelled texts of either label each term occurs; a term is a word, or a word's
    first three to seven letters (a stem).  A term's weight is the lower bound of its log odds, so rare terms count little.
    Labelled texts are dealt to folds by their text, and each fold's features come from a lexicon learned without it, so
    the trees see how well terms hold on texts that they were not learned from.
2.  Features: densities of lexicon words in tiers, nearness of hits to second-person words, shares of capitals, marks and
    symbols, masked words (letters mixed with digits or signs) and hits that show only once they are unmasked.
3.  Spark's boosted trees are fitted on the features of all folds but the last, and isotonic regression on the last turns
    their margins, rounded to a grid of fixed step, into probabilities.

The lexicons (``LEXICON`` terms each), the trees and the calibration have fixed bounds and are sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import uniform
from .common import fold, narrow, parts, slices, stored

FOLDS = 4
#: Terms of a lexicon, the least weight of a term, and the weight from which it is strong.
LEXICON = 4096
LEAST_WEIGHT = 1.0
STRONG = 3.0
#: Texts with label 1 that hold a term at least.
LEAST_TEXTS = 3
STEMS = range(3, 8)
#: Words between a hit and a second-person word that still make them near.
NEAR = 5
TREES = 30
DEPTH = 4
RATE = 0.2
SEED = 11
#: Step of the grid of margins that are calibrated.
GRID = 0.01
CUTOFF = 0.7
#: Labelled texts that the classifier is fitted on: all, or about so many by a hash of their ids where there are more.
#: The labels of that many ids are broadcast, so no text is shuffled.
FITTED = 200_000
#: Terms that a task counts, and words that a worker keeps, before it starts afresh.
HELD_TERMS = 400_000
KEPT_WORDS = 300_000

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split())
#: Signs that stand for letters.
UNMASK = str.maketrans("013457@$!", "oieastasi")

_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_SIGNS = re.compile(r"[\W_]+")
_SHOUTED = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")
_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_LETTER = bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80))
_MARKS = bytes(b for b in range(256) if b not in b"!?")
_SYMBOLS = bytes(b for b in range(256) if b not in b"#$%*&<>|@^~")

FEATURES = ["log_words", "strong", "strong_share", "weak", "weak_share", "highest", "total", "log_distinct", "stem_share", "near_share", "nearest",
            "second_person", "capitals", "shouted", "marks", "symbols", "masked", "hidden"]


def core(word: str) -> str:
    """A lower-case word without what is no letter at its ends."""
    return _EDGES.sub("", word)


def terms_of(word: str) -> tuple[str, ...]:
    """The word (two letters at least) and its stems, marked by a star."""
    c = word if word.isalpha() else core(word)
    return ((c,) if len(c) > 1 else ()) + tuple(c[:n] + "*" for n in STEMS if len(c) > n)


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-case words, in pieces of bounded size."""
    for part in parts(text.encode("utf-8", "replace")):
        yield part.decode("utf-8", "replace").lower().split()


class _Terms(dict):
    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = terms_of(word)
        return found


def term_counts(labelled: DataFrame) -> DataFrame:
    """``term`` and ``c0`` .. : texts that hold it, by fold and label (fold * 2 + label); term NULL counts the texts."""
    width = 2 * FOLDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        counts: dict[str, list[int]] = {}
        texts = [0] * width

        def flush() -> pa.RecordBatch:
            names = [None, *counts]
            columns = list(zip(texts, *counts.values()))
            counts.clear()
            texts[:] = [0] * width
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["term", *[f"c{i}" for i in range(width)]])

        for b in batches:
            for t, label, place in zip(*[c.to_pylist() for c in b.columns]):
                cell = 2 * place + label
                texts[cell] += 1
                seen: set[str] = set()
                for words in words_of(t or ""):
                    seen.update(*map(terms.__getitem__, set(words)))
                for term in seen:
                    if (c := counts.get(term)) is None:
                        counts[term] = c = [0] * width
                    c[cell] += 1
                if len(counts) > HELD_TERMS:
                    yield flush()
        yield flush()

    columns = [f"c{i}" for i in range(width)]
    made = labelled.select("text", "label", "fold").mapInArrow(run, "term string, " + ", ".join(f"{c} bigint" for c in columns))
    return made.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns])


def lexicons(counts: DataFrame) -> list[dict[str, float]]:
    """Per fold the weights of terms learned from the other folds, and at last those learned from all."""
    totals = counts.where("term is null").first()
    have = [int(totals[f"c{i}"]) if totals else 0 for i in range(2 * FOLDS)]
    some = counts.where(F.col("term").isNotNull() & (sum(F.col(f"c{2 * k + 1}") for k in range(FOLDS)) >= LEAST_TEXTS))
    made = []
    for left_out in [*range(FOLDS), None]:
        used = [k for k in range(FOLDS) if k != left_out]
        clean, toxic = (sum(have[2 * k + label] for k in used) for label in (0, 1))
        n0, n1 = (sum(F.col(f"c{2 * k + label}") for k in used) for label in (0, 1))
        odds = F.log((n1 + 0.5) / (toxic + 1.0)) - F.log((n0 + 0.5) / (clean + 1.0))
        bound = odds - 2 * F.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
        made.append(F.struct(F.lit(len(made)).alias("which"), n1.alias("n1"), bound.alias("weight")))
    each = some.select("term", F.explode(F.array(*made)).alias("x")).select("term", "x.which", "x.n1", F.round("x.weight", 6).alias("weight")).where(
        (F.col("n1") >= LEAST_TEXTS) & (F.col("weight") >= LEAST_WEIGHT))
    first = Window.partitionBy("which").orderBy(F.desc("weight"), "term")
    rows = each.withColumn("at", F.row_number().over(first)).where(F.col("at") <= LEXICON).select("which", "term", "weight").collect()
    out: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    for r in rows:
        out[r["which"]][r["term"]] = r["weight"]
    return out


class Codes(dict):
    """What a lower-case word is: its weight in hundredths, and flags."""

    SECOND, STEM, MASKED, HIDDEN = 1 << 12, 1 << 13, 1 << 14, 1 << 15
    WEIGHT = SECOND - 1

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.starts = {t[: STEMS[0]] for t in lexicon if t[-1] == "*"}

    def weight(self, name: str) -> tuple[float, bool]:
        own = self.lexicon.get(name, 0.0)
        if name[: STEMS[0]] not in self.starts:
            return own, False
        stem = max((self.lexicon.get(name[:n] + "*", 0.0) for n in STEMS if len(name) > n), default=0.0)
        return (stem, True) if stem > own else (own, False)

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        name = word if word.isalpha() else core(word)
        found, stem = self.weight(name)
        inside = name != "" and not name.isalpha()
        code = 0
        if inside:
            code |= self.MASKED
            if not found:
                found, stem = self.weight(_SIGNS.sub("", core(word.translate(UNMASK))))
                code |= self.HIDDEN * bool(found)
        code |= min(int(100 * found), self.WEIGHT) | self.STEM * stem | self.SECOND * (name in SECOND_PERSON)
        self[word] = code
        return code


def features_of(text: str | None, codes: Codes) -> list[float]:
    """The values of ``FEATURES``; a NULL text is empty."""
    text = text or ""
    found = [np.fromiter(map(codes.__getitem__, w), np.int64, len(w)) for w in words_of(text)]
    code = np.concatenate(found) if found else np.empty(0, np.int64)
    n = max(1, len(code))
    weight = (code & Codes.WEIGHT) / 100.0
    hit = np.flatnonzero(weight)
    strong = weight[hit] >= STRONG
    you = np.flatnonzero(code & Codes.SECOND)
    apart = np.full(len(hit), 1e9)
    if len(hit) and len(you):
        after = np.searchsorted(you, hit)
        apart = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - hit), np.abs(hit - you[np.maximum(after - 1, 0)])).astype(float)
    raw = text.encode("utf-8", "replace")
    letters, size = max(1, len(raw.translate(None, _LETTER))), max(1, len(raw))
    k = max(1, len(hit))
    return [np.log1p(len(code)), float(strong.sum()), strong.sum() / n, float((~strong).sum()), (~strong).sum() / n, weight.max(initial=0.0), float(weight.sum()),
            np.log1p(len(np.unique(weight[hit]))), (code[hit] & Codes.STEM > 0).sum() / k, (apart <= NEAR).sum() / k, 1 / (1 + apart.min(initial=1e9)),
            len(you) / n, len(raw.translate(None, _UPPER)) / letters, len(_SHOUTED.findall(raw)) / n, len(raw.translate(None, _MARKS)) / n,
            len(raw.translate(None, _SYMBOLS)) / size, (code & Codes.MASKED > 0).sum() / n, float((code & Codes.HIDDEN > 0).sum())]


@lru_cache(maxsize=1)
def _codes(key) -> list[Codes]:
    return [Codes(x) for x in key.value]


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


def featured(df: DataFrame, key: _Key) -> DataFrame:
    """The columns of ``df`` but ``text``, and ``features``; ``fold`` says which lexicon to use, the last where it is NULL."""
    others = [c for c in df.columns if c != "text"]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(key)
        for b in (x for whole in batches for x in slices(whole)):
            which = b.column(b.schema.get_field_index("fold")).to_pylist()
            made = [features_of(t, codes[FOLDS if f is None else f]) for t, f in zip(b.column(b.schema.get_field_index("text")).to_pylist(), which)]
            flat = pa.array(np.array(made, np.float64).ravel() if made else np.empty(0))
            ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in others], pa.ListArray.from_arrays(ends, flat)], [*others, "features"])

    return df.mapInArrow(run, f"{schema}, features array<double>")


def _margin(raw: str) -> Column:
    return F.round(vector_to_array(raw)[1] / GRID) * GRID


def train(labelled: DataFrame):
    """The lexicons (as a broadcast) and a function that adds ``score`` to a table with ``features``.

    ``labelled``: ``text``, ``label`` (0 or 1) and ``fold``.  Where all labels are equal the score is their share of 1 (0
    without any); where those of the last fold are, it is the trees' own probability.
    """
    spark = labelled.sparkSession
    have = {(r["last"], r["label"]): r["count"] for r in labelled.groupBy((F.col("fold") == FOLDS - 1).alias("last"), "label").count().collect()}
    learned = lexicons(stored(term_counts(labelled), "toxicity-terms"))
    key = _Key(spark.sparkContext.broadcast(learned), hash((spark.sparkContext.applicationId, *sorted(have.items()), *sorted(learned[-1].items()))))
    if not (have.get((False, 0)) and have.get((False, 1))):
        share = sum(n for (_, label), n in have.items() if label == 1) / max(1, sum(have.values()))
        return key, lambda df: df.withColumn("score", F.lit(float(share)))
    rows = stored(featured(labelled, key), "toxicity-features").withColumn("features", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, minInstancesPerNode=5, maxBins=64, seed=SEED).fit(rows.where(F.col("fold") < FOLDS - 1))

    def margins(df: DataFrame) -> DataFrame:
        made = trees.transform(df.withColumn("features", array_to_vector("features")))
        return made.withColumn("margin", _margin("rawPrediction")).withColumn("own", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    if not (have.get((True, 0)) and have.get((True, 1))):
        return key, lambda df: margins(df).withColumn("score", F.col("own")).drop("margin", "own")
    grid = margins(rows.where(F.col("fold") == FOLDS - 1).withColumn("features", vector_to_array("features"))).groupBy("margin").agg(
        F.avg("label").alias("share"), F.count(F.lit(1)).cast("double").alias("texts"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="share", weightCol="texts", predictionCol="score").fit(grid)
    return key, lambda df: curve.transform(margins(df)).drop("margin", "own")


def score_texts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``CUTOFF`` on).

    Learned from labelled documents whose crc32 of the id as text, modulo 3, is not 1, about ``FITTED`` of them by a hash of
    their ids where there are more; a NULL id has no label.  Several
    labels of one id count as their highest, NULL labels as none.  NULL texts are empty and are scored like any other.
    Repeated rows each count and are each scored.  Without labels all scores are 0.  An empty table gives no row.
    """
    df = narrow(docs, doc_id=id, text=text)
    known = narrow(labels, doc_id=id, label=label).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
    used = known.groupBy("doc_id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    share = FITTED / max(1, used.count())
    if share < 1:
        used = used.where(uniform(SEED, "toxicity", "doc_id") < share)
    place = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")
    key, scored = train(stored(df.where(fold("doc_id", 3) != 1).join(F.broadcast(used), "doc_id").select("text", "label", place.alias("fold")), "toxicity-labelled"))
    found = scored(featured(df.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text", F.lit(None).cast("int").alias("fold")), key))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return found.select("doc_id", "held_out", score.alias("score"), (score >= CUTOFF).cast("int").alias("predicted"))
