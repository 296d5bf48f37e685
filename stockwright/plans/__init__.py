"""Whole queries over the benchmark tables, and the SQL that checks them."""

from . import anomalies, effects, explore, files, forecasting, ingestion, live, portfolio, replenishment, synthesis  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
