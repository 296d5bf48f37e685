"""Approximate nearest neighbours by inner product: stable projections, kd-trees and a chi-square stopping test.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2), for the largest length M in
a shard.  Vectors are projected with Gaussian (2-stable) weights to ``DIMS`` coordinates, where a squared distance
divided by the true one is chi-square distributed.  A kd-tree over the projections gives its leaves in order of their
distance from a query; what lies in them is verified on the original vectors.  The search stops at the first leaf so
far away that a vector nearer than the k-th one found would, with probability ``SURE``, have been projected nearer.

Every row is indexed: each task packs the rows it reads into shards and builds a tree for each.  Queries come in
blocks of bounded size that are broadcast to all shards; a task keeps the k best of each query over all its shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, narrow

DIMS = 8
SEED = 5
SURE = 0.97
SHARD_ROWS = 8192
LEAF_ROWS = 64
#: Numbers in a block of queries (8 bytes each); leaves that are verified between two stopping tests.
BLOCK_NUMBERS = 1 << 22
STEP = 8
#: Scores nearer to each other than this are ranked by the exact sum.
SLACK = 1e-9


def chi_square(x: float, dims: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


def projection(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, DIMS))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; equal rows give equal sums wherever they stand."""
    return (a * b).sum(axis=1)


class Tree:
    """The kd-tree of a shard.  Equal vectors are one point with their ``k + 1`` smallest ids: no other can be among
    the k nearest of any query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        points, place = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, place.ravel()))
        ids, place = ids[order], place.ravel()[order]
        nth = np.arange(len(ids)) - np.searchsorted(place, place)
        ids, place = ids[nth <= k], place[nth <= k]
        norms = (points * points).sum(axis=1)
        self.longest = float(norms.max())
        extended = np.c_[points, np.sqrt(np.maximum(self.longest - norms, 0))]
        low = extended @ projection(extended.shape[1])
        leaves, work = [], [np.arange(len(points))]
        while work:
            some = work.pop()
            if len(some) <= LEAF_ROWS:
                leaves.append(some)
                continue
            part = low[some]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = np.argpartition(part[:, axis], len(some) // 2)
            work += [some[half[: len(some) // 2]], some[half[len(some) // 2 :]]]
        moved = np.concatenate(leaves)
        self.points = points[moved]
        self.start = np.cumsum([0, *map(len, leaves)])
        self.least = np.array([low[i].min(axis=0) for i in leaves])
        self.most = np.array([low[i].max(axis=0) for i in leaves])
        back = np.empty(len(points), np.int64)
        back[moved] = np.arange(len(points))
        order = np.argsort(back[place], kind="stable")
        self.ids, self.first = ids[order], np.searchsorted(back[place][order], np.arange(len(points) + 1))

    def search(self, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, point and score of every point that may be among a query's k nearest, given that ``floor`` is the
        score of the k-th one known so far."""
        low = np.c_[queries, np.zeros(len(queries))] @ projection(queries.shape[1] + 1)
        gap = np.zeros((len(queries), len(self.least)))
        for d in range(DIMS):
            gap += np.maximum(0, np.maximum(self.least[None, :, d] - low[:, d, None], low[:, d, None] - self.most[None, :, d])) ** 2
        nearest = np.argsort(gap, axis=1, kind="stable")
        gap = np.take_along_axis(gap, nearest, axis=1)
        lengths, limit = (queries * queries).sum(axis=1) + self.longest, quantile(SURE, DIMS)
        kth = floor.copy()
        q_all, p_all, s_all = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        active = np.arange(len(queries))
        for at in range(0, nearest.shape[1], STEP):
            # the stopping test: distance of the next leaf against that of the k-th neighbour
            active = active[gap[active, at] < np.maximum(lengths[active] - 2 * kth[active], 0) * limit]
            if not len(active):
                break
            wanted = nearest[active, at : at + STEP]
            found = []
            for leaf in np.unique(wanted):
                who = active[(wanted == leaf).any(axis=1)]
                a, z = self.start[leaf], self.start[leaf + 1]
                score = queries[who] @ self.points[a:z].T
                row, col = np.nonzero(score >= kth[who, None] - SLACK)
                found.append((who[row], a + col, score[row, col]))
            q_all = np.concatenate([q_all, *[f[0] for f in found]])
            p_all = np.concatenate([p_all, *[f[1] for f in found]])
            s_all = np.concatenate([s_all, *[f[2] for f in found]])
            order = np.lexsort((-s_all, q_all))
            q_all, p_all, s_all = q_all[order], p_all[order], s_all[order]
            begin = np.searchsorted(q_all, np.arange(len(queries) + 1))
            has = begin[1:] - begin[:-1] >= k + 1  # one may be the query itself
            kth[has] = np.maximum(kth[has], s_all[begin[:-1][has] + k])
            keep = s_all >= kth[q_all] - SLACK
            q_all, p_all, s_all = q_all[keep], p_all[keep], s_all[keep]
        return q_all, p_all, s_all


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.q, self.id, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, tree: Tree) -> None:
        q, p, _ = tree.search(self.vectors, self.floor, self.k)
        score = np.concatenate([exact(self.vectors[q[i : i + 65_536]], tree.points[p[i : i + 65_536]]) for i in range(0, len(q), 65_536)] or [np.empty(0)])
        n = tree.first[p + 1] - tree.first[p]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q, score, ids = np.repeat(q, n), np.repeat(score, n), tree.ids[np.repeat(tree.first[p], n) + offset]
        other = ids != self.ids[q]
        q = np.concatenate([self.q, q[other]])
        ids, score = np.concatenate([self.id, ids[other]]), np.concatenate([self.score, score[other]])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < self.k
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]
        last = nth == self.k - 1
        self.floor[q[last]] = score[last]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of equal size, of the rows that take part."""
    for b in batches:
        vectors = b.column(1)
        sizes = np.asarray(vectors.value_lengths().fill_null(0))
        flat = vectors.flatten()
        missing = np.asarray(flat.is_null())
        values = np.asarray(flat.fill_null(0)).astype(np.float64)
        ends = np.cumsum(sizes)
        ids, some = b.column(0), np.asarray(b.column(0).is_valid())
        numbers = np.asarray(ids.fill_null(0)).astype(np.int64)
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero((sizes == size) & some)
            if not len(rows):
                continue
            place = (ends[rows] - size)[:, None] + np.arange(size)
            v = values[place]
            good = np.isfinite(v).all(axis=1) & ~missing[place].any(axis=1) & (v != 0).any(axis=1)
            if good.any():
                yield numbers[rows[good]], v[good]


def nearest(table: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest found of each row whose id is divisible
    by ``every``, among all rows with another id; nearest first, ties to the smaller id.

    The score is the inner product of the original vectors in double precision.  Rows with a NULL id, or a vector that
    is NULL, empty, zero or holds NULL or non-finite numbers, take no part; vectors meet only those of equal size.
    Repeated rows are candidates each; a repeated query is answered each time.  Fewer candidates than k: all of them.
    """
    df = narrow(table, vec_id=id, vector=vector)
    held = df.where("vec_id is not null and vector is not null")
    asked = cut(held.where(F.col("vec_id") % every == 0))
    n = asked.count()
    size = (asked.agg(F.max(F.size("vector"))).first()[0] or 1) if n else 1
    blocks = max(1, -(-n * size // BLOCK_NUMBERS))
    # queries of one block: a bounded share, by hash
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = list(_usable(dealt.where(F.col("block") == block).select("vec_id", "vector").toArrow().to_batches()))
        sent = table.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, block=block) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, tuple] = {}
            for ids, vectors in sent.value:
                by_size.setdefault(vectors.shape[1], []).append((ids, vectors))
            best = {s: Best(np.concatenate([i for i, _ in r]), np.concatenate([v for _, v in r]), k) for s, r in by_size.items()}
            held: dict[int, list] = {}

            def close(s: int) -> None:
                rows = held.pop(s)
                if s in best:
                    best[s].add(Tree(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), k))

            for ids, vectors in _usable(batches):
                s = vectors.shape[1]
                held.setdefault(s, []).append((ids, vectors))
                if sum(len(i) for i, _ in held[s]) >= SHARD_ROWS:
                    close(s)
            for s in list(held):
                close(s)
            for s, b in best.items():
                yield pa.RecordBatch.from_pydict({"block": np.full(len(b.q), block), "size": np.full(len(b.q), s), "query": b.q, "query_id": b.ids[b.q], "vec_id": b.id, "score": b.score})

        part = held.mapInArrow(run, "block bigint, size bigint, query bigint, query_id bigint, vec_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("block", "size", "query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
