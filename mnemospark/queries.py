"""Registry of the engine's queries; importing the modules of ``plans`` registers them."""

from __future__ import annotations

from mnemospark.plans import graph, learning, memory, retrieval, rollups, stores, streams, text, vectors  # noqa: F401
from mnemospark.plans.registry import ORACLES, QUERIES


def entry(spark, sf_dir):
    return QUERIES["v07_hybrid_search"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
