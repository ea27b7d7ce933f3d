"""All queries of the engine and their SQL, except those of the training-data operators."""

from __future__ import annotations

from . import corpus_queries, layout_queries, retrieval_queries, system_queries

MODULES = (corpus_queries, layout_queries, retrieval_queries, system_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
