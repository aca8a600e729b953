"""Registered queries over the test tables and their SQL equivalents."""

from __future__ import annotations

from . import alignment_queries, io_queries, sequence_queries

QUERIES: dict = alignment_queries.QUERIES | sequence_queries.QUERIES | io_queries.QUERIES
ORACLES: dict[str, str] = alignment_queries.ORACLES | sequence_queries.ORACLES | io_queries.ORACLES
