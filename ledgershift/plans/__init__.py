"""Registered queries."""

from . import docs, ingest, kpi, matrix, rules, stored, views  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
