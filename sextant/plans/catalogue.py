"""Registered queries of the core and their SQL."""

from __future__ import annotations

from sextant.plans import reference_queries

QUERIES = reference_queries.QUERIES
SQL = reference_queries.SQL
