"""Queries over the driver tables, one per operator or tight group."""

from __future__ import annotations

import importlib

MODULES = ["event_queries", "feature_queries", "market_queries", "weight_queries",
           "portfolio_queries", "diagnostic_queries", "ingest_queries",
           "learning_queries", "store_queries"]


def load():
    for m in MODULES:
        importlib.import_module(f"eventide.driver.{m}")
    from eventide.driver.registry import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
