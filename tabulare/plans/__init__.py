"""Registered queries over the driver's tables and their DuckDB oracles."""

from tabulare.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
