"""The query registry: each query with, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .canonical import Tables, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def r(column, digits: int = 6) -> Column:
    """A double rounded for output."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits)


def day_text(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.date_format(column, "yyyy-MM-dd")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text, booleans and whole numbers as they are."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float") or kind.startswith("decimal"):
            out.append((F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name))
        elif kind == "date":
            out.append(day_text(name).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
