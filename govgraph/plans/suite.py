"""All registered queries."""

from govgraph.plans import (  # noqa: F401
    governance_queries,
    graph_queries,
    inference_queries,
    operations_queries,
    profile_queries,
    release_queries,
    source_queries,
)
from govgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
