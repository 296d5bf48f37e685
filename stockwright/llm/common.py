"""What the text operators share: word pattern, narrow inputs, clean-up of names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, prepare, stored

#: A word: a run without ASCII white space.  ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def narrow(df: DataFrame, **columns: str | None) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns, whatever they are called, stay out.

    A column given as ``None`` becomes NULL.  Also prepares the session.
    """
    prepare(df.sparkSession)
    return df.select(*[(F.lit(None).cast("string") if c is None else df[c]).alias(n) for n, c in columns.items()])


def slices(b: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes, one row at least."""
    step = max(1, int(b.num_rows * size / max(1, b.nbytes)))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What ``make`` makes, kept in this process for the next task; what was kept under another key is let go.

    Workers serve one stage after another: tables of the stages before would only fill their memory.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def parts(data: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut at white space."""
    at = 0
    while len(data) - at > size and (m := _SPACE.search(data, at + size)):
        yield data[at : m.start()]
        at = m.end()
    yield data[at:] if at else data


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts


__all__ = ["WORD", "cut", "fold", "held", "narrow", "parts", "prepare", "slices", "stored"]
