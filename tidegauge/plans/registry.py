"""All registered queries and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "lab_queries", "pit_queries", "price_queries", "reconcile_queries", "evaluate_queries", "event_queries", "network_queries",
    "ledger_queries", "foundation_queries", "record_queries", "attempt_queries", "stream_queries",
    "observation_queries",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"tidegauge.plans.{name}"), attribute)
        repeated = merged.keys() & part.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
