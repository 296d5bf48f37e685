"""Byte-level BPE with batched numpy merge rounds.

The words of a batch are put into one flat symbol array.  In each round every adjacent pair is looked up by binary
search over the sorted pair keys, the pair of lowest rank in each word is found, and all its places are merged at once.
A merge makes a symbol that only pairs of higher rank contain, so this equals merging one pair at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import held, narrow, slices

#: The splitting pattern of this vocabulary family.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces in either half of what a worker keeps, and symbols merged together.
KEPT_PIECES = 150_000
SYMBOLS = 1 << 18


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Bpe:
    """A byte-level BPE vocabulary read from the text of its JSON file; ``numbers``: whether ids are also given as text."""

    def __init__(self, source: str, numbers: bool = True):
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = {letter: b for b, letter in byte_letters().items()}
        self.byte_id = np.zeros(256, np.int64)
        self.content: list[bytes] = [b""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.content[i] = bytes(to_byte[c] for c in token)
            if len(token) == 1:
                self.byte_id[to_byte[token]] = i
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.content[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pieces = regex.compile(PIECES)
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.decimal = [str(i) for i in range(len(self.content))] if numbers else []
        self.raw: dict[str | int, bytes] = {}  # a piece's ids as int32 bytes
        self.text: dict[str | int, str] = {}  # and as joined numbers
        self.older: tuple[dict, dict] = ({}, {})
        self.flat = np.frombuffer(b"".join(self.content), np.uint8)
        self.sizes = np.array([len(c) for c in self.content], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's begin; words are not empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbol), -1, np.int64)  # of the pair that begins here; -1: to be looked up
        none = len(self.pair_rank)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            ask = np.flatnonzero(rank < 0)
            right = np.minimum(ask + 1, len(symbol) - 1)
            key = symbol[ask] << 32 | symbol[right]
            at = np.minimum(np.searchsorted(self.pair_key, key), none - 1)
            found = (self.pair_key[at] == key) & (word[ask] == word[right]) & (right > ask)
            rank[ask] = np.where(found, self.pair_rank[at], none)
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, head)
            lowest = np.repeat(best, np.diff(np.r_[head, len(word)]))
            over = lowest == none
            if over.any():  # words without a pair are finished
                done.append((word[over], symbol[over]))
                symbol, word, rank, lowest = symbol[~over], word[~over], rank[~over], lowest[~over]
                if not len(symbol):
                    break
            hit = rank == lowest
            if (hit[1:] & hit[:-1]).any():  # equal symbols in a row: pairs from the left
                spot = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], spot, 0))
                hit &= (spot - begin) % 2 == 0
            symbol[hit] = self.made[rank[hit]]
            rank[hit] = -1
            rank[np.maximum(np.flatnonzero(hit) - 1, 0)] = -1
            keep = np.r_[True, ~hit[:-1]]
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
        word = np.concatenate([w for w, _ in done])
        symbol = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def learn(self, pieces: set[str]) -> None:
        """Make ``raw`` and ``text`` hold all of ``pieces``, merged in blocks of bounded size; the older half is let go."""
        if len(self.raw) > KEPT_PIECES:
            self.older, self.raw, self.text = (self.raw, self.text), {}, {}
        block, size = [], 0
        older, older_text = self.older
        for p in pieces.difference(self.raw):
            if p in older:
                self.raw[p] = older[p]
                if self.decimal:
                    self.text[p] = older_text[p]
                continue
            block.append(p)
            size += len(p)
            if size >= SYMBOLS:
                self._keep(block)
                block, size = [], 0
        if block:
            self._keep(block)

    def _keep(self, block: list[str]) -> None:
        ids, starts = self.merge([p.encode() for p in block])
        raw = ids.astype(np.int32).tobytes()
        starts = starts.tolist()
        for p, a, z in zip(block, starts, starts[1:]):
            self.raw[p] = raw[4 * a : 4 * z]
        if self.decimal:
            text = [self.decimal[i] for i in ids.tolist()]
            for p, a, z in zip(block, starts, starts[1:]):
                self.text[p] = ",".join(text[a:z])

    def split(self, text: str) -> list[str | int]:
        """Pieces of the text in order; a special token is given by its id."""
        out: list[str | int] = []
        at = 0
        if self.marks:
            for m in self.marks.finditer(text):
                out += self.pieces.findall(text[at : m.start()])
                out.append(self.special[m[0]])
                at = m.end()
        out += self.pieces.findall(text[at:] if at else text)
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Per text its ids, and the same as decimal numbers joined by commas (empty without ``numbers``)."""
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= SYMBOLS:
                yield from self._encode(block)
                block, size = [], 0
        yield from self._encode(block)

    def _encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split).difference(self.special.values()))
        self.raw.update((i, np.int32(i).tobytes()) for i in self.special.values())
        if self.decimal:
            self.text.update((i, self.decimal[i]) for i in self.special.values())
        raw, number = self.raw.__getitem__, self.text.__getitem__
        for s in split:
            yield np.frombuffer(b"".join(map(raw, s)), np.int32), ",".join(map(number, s)) if self.decimal else ""

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for at in range(0, len(ids), SYMBOLS):
            some = ids[at : at + SYMBOLS]
            size = self.sizes[some]
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out.append(self.flat[np.repeat(self.starts[some], size) + place].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def load(source: str, numbers: bool = True) -> Bpe:
    return held(("bpe", source, numbers), lambda: Bpe(source, numbers))


def read_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and broadcast: its size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array<int>), ``decoded``: every whole text encoded, and its ids decoded again.

    A NULL text counts as empty: no ids and an empty decoded text.  Repeated rows are each encoded.
    """
    df = narrow(docs, doc_id=id, text=text)
    source = read_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(source.value, numbers=False)
        for b in (x for whole in batches for x in slices(whole, 2 << 20)):
            made = [ids for ids, _ in bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])]
            flat = np.concatenate(made) if made else np.empty(0, np.int32)
            ends = np.cumsum([0, *map(len, made)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array([bpe.decode(i) for i in made], pa.string())], ["doc_id", "ids", "decoded"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` reduced to ``n_tokens`` and the digests of ids and decoded text where the ids are made."""
    df = narrow(docs, doc_id=id, text=text)
    source = read_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(source.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in (x for whole in batches for x in slices(whole)):
            n, a, d = [], [], []
            for ids, joined in bpe.encode_batch([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                a.append(sha(joined))
                d.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

