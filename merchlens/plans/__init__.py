"""Query registry; importing a module registers its queries."""

from merchlens.plans import catalog_queries, querylog_queries, search_queries, evaluation_queries, evidence_queries  # noqa: F401
from merchlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
