"""Alignment of two tokenizations of the same text by pointer jumping.

Both token sequences spell the same bytes, so a token of one overlaps a run of tokens of the other.  Every token points to
the farthest-right token that overlaps it and does not end before it; a token of B that no token of A outreaches points to
itself.  Successors are doubled for all tokens of many texts at once until nothing changes: every token then points to the
last token of its component, and the components are the groups, the finest cuts at byte offsets where tokens of both end.

All pairs of a token of A and a token of B in one group are links.  Inside a group equal ids are taken together before
they are paired, so a group costs the product of its distinct ids.  A text's distinct pairs are stored, counted once per
text over the corpus, and looked up again: pairs that hold at least ``SHARE`` of the counts by broadcast (there are at most
``1 / SHARE``), all others by a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import PIECES, byte_letters
from .common import narrow, slices, stored

SHARE = 2e-6
#: Bytes of text that are aligned together, pairs that are made together, and distinct pairs that a task holds.
BLOCK_BYTES = 2 << 20
PAIRS = 1 << 21
HELD_PAIRS = 1 << 21
SPACE = "▁"


class Tokens:
    """Bytes of each id, as one flat array."""

    def __init__(self, content: list[bytes]):
        self.sizes = np.array([len(c) for c in content], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(content), np.uint8)

    def spelled(self, ids: np.ndarray) -> bytes:
        size = self.sizes[ids]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.starts[ids], size) + place].tobytes()


class Pair:
    """Both tokenizers, read from the contents of their files."""

    def __init__(self, a_source: str, b_source: bytes):
        spec = json.loads(a_source)
        special = {t["content"] for t in spec["added_tokens"]}
        vocab, letters = spec["model"]["vocab"], {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids of merged tokens must rise with their ranks")
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        content = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            content[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_source)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_tokens = Tokens(content)
        self.b_tokens = Tokens([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])
        self.width = len(pieces)
        self.kind = np.uint32 if len(content) * self.width < 1 << 32 else np.uint64
        # decimal texts of ids, with what follows them inside a group and at its end
        self.a_text = np.array([f"{i}{end}" for end in ",|" for i in range(len(content))], object)
        self.b_text = np.array([f"{i}{end}" for end in ",;" for i in range(self.width)], object)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both; both are empty where a text is, or where either doesn't spell a space and the text."""
        none = np.empty(0, np.int64)
        found_a, found_b = [], []
        for t in texts:
            a = b = none
            if t:
                whole = " " + t
                a, b = np.array(self.a.encode_ordinary(whole), np.int64), np.array(self.b.encode(t), np.int64)
                want = whole.encode()
                if self.a_tokens.spelled(a) != want or self.b_tokens.spelled(b) != want:
                    a = b = none
            found_a.append(a)
            found_b.append(b)
        return found_a, found_b


@lru_cache(maxsize=1)
def load(a_source: str, b_source: bytes) -> Pair:
    return Pair(a_source, b_source)


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0, of the tokens that end at these ascending offsets; both end at the same last one."""
    n = len(a_ends)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    to_b = np.searchsorted(b_ends, a_ends)  # the token of B that holds the last byte of A's token
    to_a = np.searchsorted(a_ends, b_ends)
    own = n + np.arange(len(b_ends))
    successor = np.r_[n + to_b, np.where(a_ends[to_a] > b_ends, to_a, own)]
    while True:
        farther = successor[successor]
        if (farther == successor).all():
            break
        successor = farther
    last = np.cumsum(successor[n:] == own) - 1
    group = last[successor - n]
    return group[:n], group[n:]


def _counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the sum of their weights (or their number)."""
    if weights is None:
        return np.unique(values, return_counts=True)
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return values[head], np.add.reduceat(weights, head) if len(head) else weights


def linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, text_of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, pairs (id of A times ``width`` plus id of B) and their numbers of links, ascending and distinct.

    ``text_of``: the text of each group.
    """
    span = np.int64(1) << 24  # more than any id
    key_a, times_a = _counted(group_a * span + a)
    key_b, times_b = _counted(group_b * span + b)
    of_a, of_b = key_a // span, key_b // span
    first = np.searchsorted(of_b, np.arange(len(text_of) + 1))
    each = np.diff(first)[of_a]  # distinct tokens of B beside each of A
    upto = np.r_[0, np.cumsum(each)]
    texts, pairs, times = [], [], []
    at = 0
    while at < len(key_a):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
        n = each[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = first[of_a[i]] + np.arange(len(i)) - np.repeat(upto[at:end] - upto[at], n)
        text, pair, many = text_of[of_a[i]], (key_a[i] % span) * width + key_b[j] % span, times_a[i] * times_b[j]
        keys, inverse = np.unique(text * (np.int64(1) << 40) + pair, return_inverse=True)
        texts.append(keys >> 40)
        pairs.append(keys & ((np.int64(1) << 40) - 1))
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, inverse, many)
        times.append(sums)
        at = end
    if len(texts) < 2:
        return (texts[0], pairs[0], times[0]) if texts else (np.empty(0, np.int64),) * 3
    keys, sums = _counted(np.concatenate(texts) * (np.int64(1) << 40) + np.concatenate(pairs), np.concatenate(times))
    return keys >> 40, keys & ((np.int64(1) << 40) - 1), sums


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def align_block(pair: Pair, texts: list[str | None]) -> list[tuple]:
    """Per text: numbers of tokens of A, of B, of groups and links, the groups' text, distinct pairs and their links."""
    found_a, found_b = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in found], np.int64) for found in (found_a, found_b))
    a, b = (np.concatenate(found) if found else np.empty(0, np.int64) for found in (found_a, found_b))
    # the texts stand one after another, and a text's last tokens end together
    group_a, group_b = groups_of(np.cumsum(pair.a_tokens.sizes[a]), np.cumsum(pair.b_tokens.sizes[b]))
    groups = int(group_b[-1]) + 1 if len(group_b) else 0
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    last_group = np.full(len(texts), -1, np.int64)
    last_group[n_a > 0] = group_a[end_a[n_a > 0] - 1]
    last_group = np.maximum.accumulate(last_group)
    n_groups = np.diff(np.r_[-1, last_group])
    text_of = np.repeat(np.arange(len(texts)), n_groups)
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    links = np.zeros(len(texts), np.int64)
    np.add.at(links, text_of, in_a * in_b)
    # each group's tokens of A, then of B
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    joined = np.empty(len(a) + len(b), object)
    joined[np.arange(len(a)) + before_b[group_a]] = pair.a_text[a + len(pair.a_tokens.sizes) * np.r_[group_a[1:] != group_a[:-1], [True] * bool(len(a))].astype(np.int64)]
    joined[np.arange(len(b)) + (before_a + in_a)[group_b]] = pair.b_text[b + pair.width * np.r_[group_b[1:] != group_b[:-1], [True] * bool(len(b))].astype(np.int64)]
    owner, pairs, times = linked(a, b, group_a, group_b, text_of, pair.width)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    upto = [0, *(end_a + end_b).tolist()]
    return [(int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(links[i]), "".join(joined[upto[i] : upto[i + 1]].tolist())[:-1],
             pairs[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]) for i in range(len(texts))]


def read_pair(spark, a_path: str, b_path: str):
    """Both vocabulary files, read on the driver and broadcast: their sizes don't depend on the data."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


def aligned(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of A and of B
    in each group), ``pairs`` and ``times`` (packed: distinct pairs of ids, ascending, and their links in the text)."""
    return _aligned(docs, read_pair(docs.sparkSession, a_path, b_path), id, text, "groups", lambda g: g)


def _aligned(docs: DataFrame, source, id: str, text: str, name: str, shown) -> DataFrame:
    df = narrow(docs, doc_id=id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = load(*source.value), TaskContext.get().partitionId() << 40
        for b in (x for whole in batches for x in slices(whole, BLOCK_BYTES)):
            made = [r for block in _blocks(b.column(1).to_pylist()) for r in align_block(pair, block)]
            c = list(zip(*made)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(made))), b.column(0), *[pa.array(x, pa.int64()) for x in c[:4]], pa.array([shown(g) for g in c[4]], pa.string()),
                 pa.array([p.astype(pair.kind).tobytes() for p in c[5]], pa.binary()), pa.array([_small(t) for t in c[6]], pa.binary())],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", name, "pairs", "times"])
            row += len(made)

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, {name} string, pairs binary, times binary")


def _small(times: np.ndarray) -> bytes:
    """The numbers in one, two or eight bytes each."""
    top = int(times.max()) if len(times) else 0
    return times.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint64).tobytes()


def _unpacked(pairs: bytes, times: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(pairs, kind)
    n = max(1, len(found))
    return found.astype(np.int64), np.frombuffer(times, {1: np.uint8, 2: np.uint16, 8: np.uint64}[max(1, len(times) // n)]).astype(np.int64)


def pair_counts(found: DataFrame, kind: type, width: int) -> DataFrame:
    """``pair``, ``n`` (the texts that hold it linked) and ``best``: is it the highest of its id of A, ties included?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(0).to_pylist()), kind).astype(np.int64)
            new, times = np.unique(flat, return_counts=True)
            keys, n = _counted(np.concatenate([keys, new]), np.concatenate([n, times]))
            if len(keys) > HELD_PAIRS:
                yield pa.RecordBatch.from_pydict({"pair": keys, "n": n})
                keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_pydict({"pair": keys, "n": n})

    counts = stored(found.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    id_a = F.floor(F.col("pair") / width)
    highest = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("top"))  # a row per id of A at most
    return counts.withColumn("a", id_a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


@lru_cache(maxsize=1)
def _often(key) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return key.value


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


def report(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is in as many
    documents as any pair of its id of A), ``count_sum`` (over links, the documents that hold the pair linked) and
    ``groups_sha256`` of the groups' text ('' without tokens).

    NULL and empty texts, and texts that the tokens of A or B don't spell, have no tokens: all numbers are 0.  Special
    tokens' strings are plain text.  Repeated rows are each counted and each reported.  An empty table gives no row.
    """
    spark = docs.sparkSession
    source = read_pair(spark, a_path, b_path)
    pair = load(*source.value)
    kind, width = pair.kind, pair.width
    found = stored(_aligned(docs, source, id, text, "groups_sha256", lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""), "alignment-texts")
    counts = stored(pair_counts(found, kind, width), "alignment-pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_often = F.col("n") >= F.lit(total) * SHARE
    often = counts.where(is_often).toArrow()
    keys = often.column("pair").to_numpy()
    order = np.argsort(keys)
    columns = keys[order], often.column("n").to_numpy()[order], often.column("best").to_numpy()[order]
    key = _Key(spark.sparkContext.broadcast(columns), hash((spark.sparkContext.applicationId, counts.inputFiles()[0] if total else "")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = _often(key)
        for b in (x for whole in batches for x in slices(whole, BLOCK_BYTES)):
            made = [_unpacked(p, t, kind) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            size = np.array([len(p) for p, _ in made], np.int64)
            pairs, times = (np.concatenate([m[i] for m in made]) if made else np.empty(0, np.int64) for i in (0, 1))
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            owner = np.repeat(np.arange(len(made)), size)
            totals = np.zeros((2, len(made)), np.int64)
            o, t, a = owner[there], times[there], at[there]
            np.add.at(totals[0], o, t * n[a])
            np.add.at(totals[1], o[best[a]], t[best[a]])
            rest = np.searchsorted(owner[~there], np.arange(len(made) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(totals[0]), pa.array(totals[1]), pa.ListArray.from_arrays(pa.array(rest), pa.array(pairs[~there])), pa.ListArray.from_arrays(pa.array(rest), pa.array(times[~there]))],
                ["row", "count_sum", "n_best", "pairs", "times"])

    looked = stored(found.select("row", "pairs", "times").mapInArrow(look, "row bigint, count_sum bigint, n_best bigint, pairs array<bigint>, times array<bigint>"), "alignment-looked")
    rare = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    more = rare.join(counts.where(~is_often), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    sums = looked.select("row", "count_sum", "n_best").join(more, "row", "left")
    return found.drop("pairs", "times").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
