"""Every query of the core by name, with its SQL."""

from __future__ import annotations

from . import inventory_queries, lifecycle_queries, operations_queries, path_queries, problems

FLAGSHIP = "edge_topk"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for part in (problems, inventory_queries, path_queries, operations_queries, lifecycle_queries):
    QUERIES |= part.QUERIES
    ORACLE |= part.ORACLE
