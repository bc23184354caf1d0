"""The declared models and the registered queries."""

from __future__ import annotations


def registered() -> dict:
    """Every registered query by name."""
    from lakemart.plans import checks, history, loads, logs, warehouse

    return {**loads.QUERIES, **history.QUERIES, **logs.QUERIES, **checks.QUERIES, **warehouse.QUERIES}
