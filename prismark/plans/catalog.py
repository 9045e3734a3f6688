"""All queries of the engine's own operators."""

from prismark.plans import audit_queries, build_queries, facts_queries, report_queries, scoring_queries, selection_queries  # noqa: F401  (each registers its queries)
from prismark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
