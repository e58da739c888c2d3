"""Registered queries, one module per family; importing them fills QUERIES and ORACLES."""

from . import classify, evaluation, fanout, filtering, incremental, joins, normalise, relations, scoring, sources, state, vaults, vectors  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
