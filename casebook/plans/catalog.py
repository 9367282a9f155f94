"""All registered queries."""

from __future__ import annotations

from casebook.plans import evidence_queries, ingest_queries, question_queries, record_queries  # noqa: F401
from casebook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
