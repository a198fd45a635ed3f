"""All registered queries over the evidence stand-ins."""

from __future__ import annotations

from . import evidence_queries, fact_queries, more_queries, record_queries, standins, temporal_queries, view_queries  # noqa: F401 isort: skip
from . import case_queries, read_queries, source_queries  # noqa: F401 isort: skip  (restates some of the others)


def queries() -> dict:
    return dict(standins.QUERIES)


def oracle_sql() -> dict:
    return dict(standins.ORACLES)
