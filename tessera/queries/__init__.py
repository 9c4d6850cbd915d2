"""All queries of the engine and their SQL."""

from . import agent_queries, graph_queries, round_queries  # noqa: F401  (register their queries)
from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
