"""All registered queries of the engine with their oracle SQL."""

from __future__ import annotations

from . import io_queries, report_queries, review_queries, scoring_queries, stream_queries, study_queries, text_queries

MODULES = [scoring_queries, text_queries, review_queries, io_queries, study_queries, stream_queries, report_queries]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
