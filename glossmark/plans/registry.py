"""All registered queries."""

from __future__ import annotations

from glossmark.plans import corpus_queries, edge_queries, metric_queries, model_queries, oracle_queries, table_queries

MODULES = [corpus_queries, metric_queries, table_queries, model_queries, oracle_queries, edge_queries]


def registered() -> dict:
    """Name -> (query, SQL or None)."""
    table: dict = {}
    for module in MODULES:
        for name, item in module.QUERIES.items():
            if name in table:
                raise ValueError(f"query {name} is registered twice")
            table[name] = item
    return table
