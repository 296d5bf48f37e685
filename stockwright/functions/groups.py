"""Whole groups of rows inside tasks: rows of one key stand together and are worked on as matrices, many groups at once.

For groups bounded by an axis (an item's days).  A task reads its rows once and holds about ``ROWS`` of them, or one
group where that is larger: nothing is sorted, buffered or spilled per window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import stored

ROWS = 1 << 17

#: What a computation gets and gives: matrices (groups x rows) of values, and of which of them are NULL.
Matrices = dict[str, tuple[np.ndarray, np.ndarray]]


def clustered(rows: DataFrame, key: str, together: bool = False) -> DataFrame:
    """Rows of one key side by side in one task.  Rows dealt by the key are not dealt again; ``together``: rows of one
    key already follow each other (so ``demand.dense`` makes them), and are not sorted either."""
    dealt = rows.repartition(key)
    return dealt if together else dealt.sortWithinPartitions(key)


def whole(batches: Iterator[pa.RecordBatch], key: str, rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that hold whole groups, with the first row of each group; refused where the rows of
    a group do not follow each other."""
    ended: set = set()
    groups = 0
    for table, starts in _whole(batches, key, rows):
        ended.update(_flat(table, key).take(pa.array(starts)).to_pylist())
        groups += len(starts)
        if len(ended) != groups:
            raise ValueError(f"rows of one {key} do not stand together")
        yield table, starts


def _whole(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    held, n, enough = [], 0, rows
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(table, key)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), starts[:-1]
        rest = table.slice(last)
        held, n = rest.to_batches(), rest.num_rows
        enough = max(rows, 2 * n)
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts_of(table, key)


def starts_of(table: pa.Table, key: str) -> np.ndarray:
    codes = pc.dictionary_encode(_flat(table, key), null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _flat(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def in_groups(rows: DataFrame, key: str, order: str, inputs: list[str], made: dict[str, str], compute: Callable[[Matrices], dict],
              together: bool = False, kept: list[str] | None = None) -> DataFrame:
    """``rows`` (of them the columns ``kept``, by default all) with the columns ``made`` (name to type), computed from the
    matrices of ``inputs`` of equally long groups.

    A group's rows go by ``order``; ``together`` as in ``clustered``.  ``compute`` gives each new column as a matrix, or as a matrix and which of it is NULL.
    """
    names = rows.columns if kept is None else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in computed(whole(batches, key), order, inputs, names, made, compute):
            yield from table.to_batches(ROWS)

    kinds = dict(rows.dtypes)
    return clustered(rows, key, together).mapInArrow(run, _schema([*[(n, kinds[n]) for n in names], *made.items()]))


def _schema(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in fields)


def computed(groups: Iterator[tuple[pa.Table, np.ndarray]], order: str, inputs: list[str], names: list[str], made: dict[str, str],
             compute: Callable[[Matrices], dict]) -> Iterator[pa.Table]:
    """Tables of whole groups, of their columns ``names``, with the columns ``made`` as in ``in_groups``."""
    for table, starts in groups:
        counts = np.diff(np.r_[starts, table.num_rows])
        place = _flat(table, order).to_numpy(zero_copy_only=False)
        back = place[1:] < place[:-1]
        back[starts[1:] - 1] = False
        if back.any():
            table = table.take(np.lexsort((place, np.repeat(np.arange(len(starts)), counts))))
        columns = {n: _flat(table, n) for n in inputs}
        values = {n: (c.to_numpy(zero_copy_only=False), np.asarray(c.is_null())) for n, c in columns.items()}
        out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.unique(counts)
        for size in sizes:
            # groups of one size are the table itself, cut into rows
            at = starts[counts == size][:, None] + np.arange(size) if len(sizes) > 1 else None
            for n, found in compute({n: _matrix(at, size, v, m) for n, (v, m) in values.items()}).items():
                found, null = found if isinstance(found, tuple) else (found, False)
                if at is None:
                    out[n] = np.ravel(found), np.ravel(np.broadcast_to(null, found.shape))
                    continue
                if n not in out:
                    out[n] = np.empty(table.num_rows, found.dtype), np.zeros(table.num_rows, bool)
                out[n][0][at], out[n][1][at] = found, null
        new = [pa.array(out[n][0], mask=out[n][1], type=_KINDS.get(k)) for n, k in made.items()]
        yield pa.Table.from_arrays([*[_flat(table, n) for n in names], *new], [*names, *made])


def _matrix(at: np.ndarray | None, size: int, value: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (value.reshape(-1, size), null.reshape(-1, size)) if at is None else (value[at], null[at])


_KINDS = {"array<double>": pa.list_(pa.float64()), "string": pa.string()}

BLOCK = "n bigint, block binary"


class Packed(NamedTuple):
    """Rows kept as compressed Arrow tables of about ``ROWS`` rows: a row of ``blocks`` is a table and its number of rows;
    ``fields`` are the names and types of the columns.

    A computation in tasks reads the tables as they are and gives tables: no row is spelled out for the JVM in between,
    shuffled or sorted.  A block holds whole groups, where it was made of such.
    """

    blocks: DataFrame
    fields: list[tuple[str, str]]

    def count(self) -> int:
        return int(self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def select(self, *names: str) -> Packed:
        return Packed(self.blocks, [(n, dict(self.fields)[n]) for n in names])

    def drop(self, name: str) -> Packed:
        return self.select(*[n for n, _ in self.fields if n != name])

    def stored(self, name: str) -> Packed:
        return Packed(stored(self.blocks, name), self.fields)

    def rows(self, keep: Callable[[pa.Table], np.ndarray] | None = None) -> DataFrame:
        """The rows, or those that ``keep`` is true of."""
        def run(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
            for table in tables:
                yield table if keep is None else table.filter(pa.array(keep(table)))

        return self.give(run, self.fields)

    def give(self, compute: Callable[[Iterator[pa.Table]], Iterator[pa.Table]], fields: list[tuple[str, str]]) -> DataFrame:
        """The rows of the tables that ``compute`` makes of a task's tables."""
        names = [n for n, _ in self.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in compute(_tables(batches, names)):
                yield from table.to_batches(ROWS)

        return self.blocks.select("block").mapInArrow(run, _schema(fields))

    def pack(self, compute: Callable[[Iterator[pa.Table]], Iterator[pa.Table]], fields: list[tuple[str, str]]) -> Packed:
        """``give``, packed."""
        names = [n for n, _ in self.fields]
        return Packed(self.blocks.select("block").mapInArrow(lambda batches: blocks(compute(_tables(batches, names))), BLOCK), fields)


def packed(rows: DataFrame, key: str, together: bool = False) -> Packed:
    """``rows``, whole groups in a block."""
    return Packed(clustered(rows, key, together).mapInArrow(lambda batches: blocks(table for table, _ in whole(batches, key)), BLOCK), rows.dtypes)


def blocks(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Rows of ``Packed.blocks``."""
    for table in tables:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
            out.write_table(table.combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n", "block"])


def _tables(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    for b in batches:
        for block in b.column(0):
            data = block.as_buffer()
            held = pa.ipc.open_stream(data).schema
            some = pa.ipc.IpcReadOptions(use_threads=False, included_fields=[held.get_field_index(n) for n in names])
            yield pa.ipc.open_stream(data, options=some).read_all().select(names)


def median(x: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The median of each row of ``x`` without NULLs (NaN counts as the largest value), and where there is none."""
    if not null.any() and not np.isnan(x).any():
        return np.median(x, axis=1), np.zeros(len(x), bool)
    out, none = np.zeros(len(x)), np.zeros(len(x), bool)
    for row in range(len(x)):
        known = np.sort(x[row][~null[row]])
        n = len(known)
        none[row] = not n
        out[row] = 0.5 * known[(n - 1) // 2] + 0.5 * known[n // 2] if n else 0.0
    return out, none


def medians_by(place: np.ndarray, x: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``median`` of the values of the same row of ``x`` that share a place, given back at each of them."""
    out, none = np.zeros(x.shape), np.zeros(x.shape, bool)
    if (place == place[:1]).all():
        blocks = [(slice(None), np.flatnonzero(place[0] == p)) for p in np.unique(place[0])]
    else:
        blocks = [(slice(row, row + 1), np.flatnonzero(place[row] == p)) for row in range(len(x)) for p in np.unique(place[row])]
    for rows, at in blocks:
        m, gone = median(x[rows][:, at], null[rows][:, at])
        out[rows, at], none[rows, at] = m[:, None], gone[:, None]
    return out, none
