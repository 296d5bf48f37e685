"""SimHash near-duplicates: 64-bit fingerprints, BK-trees per shard, connected components.

Fingerprints within four bits of each other agree on at least one of five bit blocks (pigeonhole), so the shards are
"fingerprints that agree on a block".  Every shard gets a BK-tree: a node's children are keyed by their integer
distance to it, and a search with radius r at distance d follows only the edges d-r .. d+r.  A tree goes to the tasks
that hold its shard's fingerprints, not to all: broadcasting every tree would let each fingerprint meet each tree.
Shards above a size are cut again by the blocks of their remaining bits, so that no task holds an unbounded one.

Work that only repeats known links is left out.  All of the subtree under an edge k <= r lies within r of the node,
hence in its component; a query that is linked to the node need not enter it.  A subtree that lies in the query's own
component is not entered either.  So a dense group of n near copies costs far less than its n * n links, and what
leaves a task is one row per linked fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, narrow

SEED = 42
WIDTH = 4
RADIUS = 4
#: A shard with more fingerprints is cut again by its remaining bits (at most ``DEPTH`` times in all).
SHARD_ROWS = 4096
DEPTH = 3
#: Fingerprints whose trees are built together, and (query, node) pairs looked at together.
FOREST_ROWS = 100_000
PAIRS = 1 << 20


def fingerprint(data: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint of one text; zero if it has no word."""
    words = data.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return _majority(np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64).view(np.uint8), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - width].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], np.uint64)
    return _majority(hashes.view(np.uint8), len(hashes))


def _majority(octets: np.ndarray, n: int) -> int:
    counts = np.zeros(64, np.int64)
    rows = octets.reshape(n, 8)
    for at in range(0, n, 65_536):
        counts += np.unpackbits(rows[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (bigint holding the 64 bits) of every whole text; a NULL text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [0 if t is None else fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    df = narrow(docs, doc_id=id, text=text)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp bigint")


# --- BK-trees -------------------------------------------------------------------------------------------------


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its component) after linking ``a`` with ``b``."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low < high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


class Forest:
    """BK-trees of several shards in flat arrays; ``shard`` is ascending."""

    def __init__(self, values: np.ndarray, shard: np.ndarray, radius: int = RADIUS):
        n = len(values)
        self.values, self.radius = values, radius
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        self.parent = np.full(n, -1, np.int64)
        self.label = np.arange(n)
        self.levels: list[np.ndarray] = []
        edge_key, edge_node = [], []
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[rest]
        while len(rest):
            gap = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            near = gap <= radius
            self.label = merged(self.label, rest[near], at[near])
            key = at * 65 + gap
            order = np.argsort(key, kind="stable")
            rest, key, at = rest[order], key[order], at[order]
            head = np.r_[True, key[1:] != key[:-1]]
            nodes = rest[head]
            edge_key.append(key[head])
            edge_node.append(nodes)
            self.parent[nodes] = at[head]
            self.levels.append(nodes)
            place = np.cumsum(head) - 1
            rest, at = rest[~head], nodes[place[~head]]
        keys = np.concatenate(edge_key) if edge_key else np.empty(0, np.int64)
        order = np.argsort(keys)
        self.edge_key = keys[order]
        self.edge_node = (np.concatenate(edge_node) if edge_node else np.empty(0, np.int64))[order]

    def _uniform(self) -> np.ndarray:
        """Per node the component that holds its whole subtree, or -1."""
        low, high = self.label.copy(), self.label.copy()
        for nodes in reversed(self.levels):
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return np.where(low == high, low, -1)

    def components(self) -> np.ndarray:
        """Every value's label: the least index among those it is linked to, directly or through others."""
        n, r = len(self.values), self.radius
        step = max(8192, n // 16)
        for start in range(0, n, step):
            whole = self._uniform()
            queries = np.arange(start, min(n, start + step))
            stack = [(queries, self.root[queries])]
            while stack:
                q, node = stack.pop()
                if len(q) > PAIRS:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                open_ = whole[node] != self.label[q]
                q, node = q[open_], node[open_]
                gap = np.bitwise_count(self.values[q] ^ self.values[node]).astype(np.int64)
                near = gap <= r
                self.label = merged(self.label, q[near], node[near])
                low = np.searchsorted(self.edge_key, node * 65 + np.where(near, r + 1, gap - r))
                high = np.searchsorted(self.edge_key, node * 65 + np.minimum(gap + r, 64), side="right")
                some = np.maximum(high - low, 0)
                if total := int(some.sum()):
                    offset = np.arange(total) - np.repeat(np.cumsum(some) - some, some)
                    stack.append((np.repeat(q, some), self.edge_node[np.repeat(low, some) + offset]))
        return self.label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard: each fingerprint with the least one of its component in the shard, where they differ."""

    def solve(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        label = Forest(values.view(np.uint64), keys).components()
        moved = np.flatnonzero(values[label] != values)
        return pa.RecordBatch.from_pydict({"a": values[moved], "b": values[label[moved]]})

    keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        keys = np.concatenate([keys, b.column(0).to_numpy()])
        values = np.concatenate([values, b.column(1).to_numpy()])
        if len(keys) >= FOREST_ROWS and keys[0] != keys[-1]:
            done = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on
            yield solve(keys[:done], values[:done])
            keys, values = keys[done:], values[done:]
    if len(keys):
        yield solve(keys, values)


def _blocks(bits: list[int]) -> list[list[int]]:
    """``bits`` dealt into RADIUS + 1 blocks: values within RADIUS bits agree on one of them."""
    return [[int(x) for x in part] for part in np.array_split(bits, RADIUS + 1)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _shards(values: DataFrame) -> DataFrame:
    """``key``, ``fp``: a row for each block of each fingerprint; shards above ``SHARD_ROWS`` are cut again."""
    every = list(range(64))
    level = [(tuple(block), [b for b in every if b not in block]) for block in _blocks(every)]
    rows = values.select("fp", F.explode(F.array(*[
        F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_mask(list(block))))).alias("key"), F.lit(i).alias("path"))
        for i, (block, _) in enumerate(level)
    ])).alias("x")).select("x.key", "x.path", "fp")
    done = None
    for _ in range(DEPTH - 1):
        large = cut(rows.groupBy("key").count().where(F.col("count") > SHARD_ROWS).select("key"))
        if large.isEmpty():
            break
        small = rows.join(large, "key", "left_anti").select("key", "fp")
        done = small if done is None else done.unionByName(small)
        finer, cases = [], None
        for path, (_, rest) in enumerate(level):
            subs = _blocks(rest)
            made = F.array(*[
                F.struct(F.xxhash64(F.col("key"), F.lit(len(finer) + i), F.col("fp").bitwiseAND(F.lit(_mask(sub)))).alias("key"),
                         F.lit(len(finer) + i).alias("path"))
                for i, sub in enumerate(subs)
            ])
            finer += [(tuple(sub), [b for b in rest if b not in sub]) for sub in subs]
            cases = F.when(F.col("path") == path, made) if cases is None else cases.when(F.col("path") == path, made)
        rows = rows.join(large, "key", "left_semi").select("fp", F.explode(cases).alias("x")).select("x.key", "x.path", "fp")
        level = finer
    rows = rows.select("key", "fp")
    return rows if done is None else done.unionByName(rows)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node reachable) of every node of ``edges`` (a, b): alternating large and small
    stars, each a grouped minimum and a join, so that a node with very many neighbours is pre-aggregated."""

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = mark(edges)
    while seen[0]:
        pairs = both(edges)
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = cut(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` and ``copies`` (documents
    of the component).  Documents are linked if their fingerprints differ in four bits or less.

    NULL and empty texts have the fingerprint zero and are linked like others.  Repeated rows are each returned.  A
    component's id is its smallest id that is not NULL; it is NULL if there is none.  An empty table gives no row.
    """
    marked, rooted = _grouped(docs, id, text)
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("copies"))
    named = cut(rooted.select("fp", "root").join(heads, "root").select("fp", "component_id", "copies"))
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "copies"
    )


def _grouped(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``fp`` of every document; and of every fingerprint ``fp``, ``root`` (the least of its component),
    ``first`` (its smallest id) and ``n`` (its documents)."""
    marked = cut(fingerprints(docs, id, text))
    values = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    rows = values.count() * (RADIUS + 1)
    shards = _shards(values.select("fp"))
    tasks = max(1, -(-rows // FOREST_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = shards.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_links, "a bigint, b bigint")
    known = components(edges)
    rooted = values.join(known, values.fp == known.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n")
    return marked, rooted


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document (all columns) of each component of ``docs``: the one with the smallest id, NULL being the last;
    among rows with this id the one with the smallest fingerprint, among these the least row.

    Rows whose id no other row has are told by it; rows without an id or with a repeated one by id and fingerprint.
    """
    marked, rooted = _grouped(docs, id, text)
    heads = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("w"))
    repeated = marked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    winners = heads.select(F.col("w.first").alias("keep_id"), F.col("w.fp").alias("keep_fp"))
    winners = cut(winners.join(repeated, F.col("keep_id") == F.col("again"), "left").select(
        "keep_id", "keep_fp", (F.col("keep_id").isNull() | F.col("again").isNotNull()).alias("more")))
    held = docs.select(docs[id].alias("held_id"), docs[text].alias("text"), F.struct(*[docs[n] for n in docs.columns]).alias("row"))
    once = held.join(winners.where(~F.col("more")), F.col("held_id") == F.col("keep_id"), "left_semi").select("row")
    shared = cut(winners.where("more").select("keep_id", "keep_fp"))
    if shared.isEmpty():
        return once.select("row.*")
    some = held.where("held_id IS NULL").unionByName(held.join(shared.select("keep_id").distinct(), F.col("held_id") == F.col("keep_id"), "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [0 if t is None else fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), b.column(2)], ["held_id", "held_fp", "row"])

    told = some.mapInArrow(run, StructType([some.schema["held_id"], StructField("held_fp", LongType()), some.schema["row"]]))
    least = told.groupBy("held_id", "held_fp").agg(F.min("row").alias("row"))
    mine = F.col("held_id").eqNullSafe(F.col("keep_id")) & (F.col("held_fp") == F.col("keep_fp"))
    return once.unionByName(least.join(shared, mine, "left_semi").select("row")).select("row.*")
