"""Jobs and registered queries."""

from quillgraph.plans import graph_queries, sink_queries, works_queries  # noqa: F401
from quillgraph.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
