"""Registered queries and their SQL oracles."""

from __future__ import annotations

from . import calendar_queries, composite_queries, diagnostic_queries, evaluation_queries, grid_queries, model_queries, source_queries, spatial_queries, weather_queries  # noqa: F401  they register themselves
from .frames import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
