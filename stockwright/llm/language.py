"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone.  A trigram's vector binds its letters:
the product of the first letter's vector rotated twice, the second's rotated once and the third's.  A text's vector
bundles (adds) the vectors of its trigrams; a language's prototype bundles the texts known to be in it.  A text is in
the language whose prototype has the largest cosine with it.

Prototypes are sums, so tasks add up their own texts and Spark adds the sums: one row per language and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, held, narrow, prepare, slices

SIZE = 512
SEED = 6
#: Trigrams whose vectors a worker keeps, trigrams and texts that are bundled together.
KEPT_TRIGRAMS = 1 << 16
BLOCK = 1 << 13
TOGETHER = 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1 << 15)
def letter_vector(code: int, size: int = SIZE, seed: int = SEED) -> np.ndarray:
    return (np.random.default_rng([seed, code]).integers(0, 2, size) * 2 - 1).astype(np.int8)


def pieces(texts: list[str], size: int) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (place in ``texts``, text) of about ``size`` characters; longer texts are cut at spaces."""
    block, chars = [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = len(t) if len(t) - at <= size else t.find(" ", at + size) + 1 or len(t)
            block.append((i, t[at:end]))
            chars += end - at
            at = end
            if chars >= size or len(block) >= TOGETHER:
                yield block
                block, chars = [], 0
    if block:
        yield block


class Vectors:
    """Bundles texts; keeps the vectors of the trigrams seen lately."""

    def __init__(self, size: int = SIZE):
        self.size, self.place = size, {}
        self.rows = np.empty((1024, size), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of at most ``BLOCK`` trigrams, one a row."""
        names = grams.tolist()
        fresh = [g for g in names if g not in self.place]
        if len(self.place) + len(fresh) > KEPT_TRIGRAMS:
            self.place, fresh = {}, names
        need = len(self.place) + len(fresh)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty((max(need, 2 * len(self.rows)) - len(self.rows), self.size), np.int8)])
        for g in fresh:
            a, b, c = (letter_vector(g >> s & 0x1FFFFF, self.size) for s in (42, 21, 0))
            self.rows[len(self.place)] = np.roll(a, 2) * np.roll(b, 1) * c
            self.place[g] = len(self.place)
        return self.rows[np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))].astype(np.float32)

    def bundle(self, texts: list[str]) -> np.ndarray:
        """A row per text: the sum of its trigrams' vectors, zero if it has no letter.

        A trigram is a letter with its neighbours; what is no letter counts as a space.
        """
        out = np.zeros((len(texts), self.size), np.float32)
        for block in pieces(texts, 1 << 20):
            letter = np.r_[0, _letters()[np.frombuffer(" ".join(t for _, t in block).encode("utf-32-le", "replace"), np.uint32)], 0]
            owner = np.repeat(np.arange(len(block)), [len(t) + 1 for _, t in block])
            mid = np.flatnonzero(letter)
            if not len(mid):
                continue
            alphabet = np.unique(letter[mid])
            alphabet, width = np.r_[0, alphabet], len(alphabet) + 1
            small = np.searchsorted(alphabet, letter) if width > 256 else self._ranks(alphabet)[letter]
            code = (small[mid - 1] * width + small[mid]) * width + small[mid + 1]
            if width**3 <= 1 << 22:
                found = np.zeros(width**3, bool)
                found[code] = True
                there = np.flatnonzero(found)
                place = np.empty(width**3, np.int32)
                place[there] = np.arange(len(there))
                place = place[code]
            else:
                there, place = np.unique(code, return_inverse=True)
            gram = alphabet[there // (width * width)] << 42 | alphabet[there // width % width] << 21 | alphabet[there % width]
            owner = owner[mid - 1]
            to = np.array([i for i, _ in block])
            for at in range(0, len(there), BLOCK):
                n = min(BLOCK, len(there) - at)
                own, col = owner, place
                if len(there) > BLOCK:
                    inside = (place >= at) & (place < at + n)
                    own, col = owner[inside], place[inside] - at
                counts = np.bincount(own * n + col, minlength=len(block) * n).astype(np.float32).reshape(len(block), n)
                np.add.at(out, to, counts @ self.of(gram[at : at + n]))
        return out

    @staticmethod
    def _ranks(alphabet: np.ndarray) -> np.ndarray:
        ranks = np.zeros(0x110000, np.int64)
        ranks[alphabet] = np.arange(len(alphabet))
        return ranks


def _vectors() -> Vectors:
    return held("language", Vectors)


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang`` and ``vector`` (array<double>): the bundle of all texts of each language that is not NULL.

    Texts without letters add nothing; a language with no other texts has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        vectors = _vectors()
        for b in batches:
            for some in slices(b):
                made = vectors.bundle(some.column(0).to_pylist())
                made = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-30)
                names = np.array(some.column(1).to_pylist(), object)
                for name in set(names.tolist()):
                    total = made[names == name].sum(axis=0, dtype=np.float64)
                    if total.any():
                        sums[name] = sums.get(name, 0) + total
        yield pa.RecordBatch.from_pydict({"lang": pa.array(sums, pa.string()), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    sums = narrow(docs, text=text, lang=lang).where("text is not null and lang is not null").mapInArrow(run, "lang string, vector array<double>")
    spread = sums.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    return spread.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("vector"))


class Judge:
    """Language and cosine of a text, by prototypes collected here: a row of ``SIZE`` numbers for each language."""

    def __init__(self, learned: DataFrame):
        known = sorted((r["lang"], r["vector"]) for r in learned.collect())
        self.names = [n for n, _ in known]
        profile = np.array([v for _, v in known], np.float64).reshape(len(known), SIZE)
        self.profile = (profile / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-300)).astype(np.float32)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        made = _vectors().bundle([t or "" for t in texts])
        norm = np.linalg.norm(made, axis=1)
        score = made @ self.profile.T / np.maximum(norm, 1e-30)[:, None]
        best = np.argmax(score, axis=1)
        return [(self.names[k], min(1.0, max(0.0, float(score[i, k])))) if norm[i] else (UNKNOWN, 0.0) for i, k in enumerate(best)]


def predict(docs: DataFrame, learned: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (cosine, at least 0) of every whole text by the prototypes ``learned``.

    ``und`` and 0 for NULL
    texts, texts without a letter, and if no language was learned.  Ties go to the first language by code point.
    """
    judge = Judge(learned)
    df = narrow(docs, doc_id=id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            made = judge(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from two thirds of the documents (crc32 of the id as text, modulo 3, is not 1) and predict all.

    One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.  A NULL id counts as the empty text.
    """
    df = narrow(docs, doc_id=id, text=text, lang=lang)
    learned = prototypes(df.where(fold("doc_id", 3) != 1))
    return predict(df, learned).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def labelled(docs: DataFrame, text: str = "text", lang: str = "lang", least: float = 0.0) -> DataFrame:
    """``docs`` (all columns) with ``lang`` predicted; documents in no language (``und``, or a score below ``least``) go.

    The prototypes are learned from the languages that ``docs`` gives.
    """
    prepare(docs.sparkSession)
    judge = Judge(prototypes(docs, text, lang))
    at, to = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole)):
            found = pa.array([n if n != UNKNOWN and s >= least else None for n, s in judge(b.column(at).to_pylist())], pa.string())
            yield b.set_column(to, b.schema.field(to), found.cast(b.schema.field(to).type)).filter(found.is_valid())

    return docs.mapInArrow(run, docs.schema)

