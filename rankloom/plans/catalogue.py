"""All named queries of the reference operators and their SQL twins."""

from __future__ import annotations

from . import queries_data, queries_flow, queries_io, queries_more, queries_rating, queries_stores, queries_text, queries_variants, queries_wide

PARTS = (queries_rating, queries_data, queries_text, queries_more, queries_wide, queries_stores, queries_flow, queries_variants, queries_io)
QUERIES: dict = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict = {k: s for part in PARTS for k, s in part.SQL.items()}
