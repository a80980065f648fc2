"""All registered queries of the engine, with their SQL oracles."""

from __future__ import annotations

from . import scalar, tables

FLAGSHIP = "advisory_end_to_end"


def queries() -> dict:
    return scalar.QUERIES | tables.QUERIES


def oracle_sql() -> dict:
    return scalar.SQL | tables.SQL
