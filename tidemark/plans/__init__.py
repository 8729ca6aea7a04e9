"""Registered queries: each pairs a Spark query over the given tables with equivalent SQL text where SQL can say it."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import ORACLES, QUERIES

MODULES = (
    "series", "quality", "chain", "joins", "labels", "structures", "economics", "evaluation", "journal", "regimes", "decisions",
    "models", "sources", "streams",
)


def load() -> None:
    """Import every module of queries, which fills the registry."""
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
