"""Composed corpus plans and the registry of checkable queries."""

from __future__ import annotations


def all_queries() -> dict:
    """Import every module of queries and return what they registered."""
    from lexloom.plans import (  # noqa: F401
        corpus_queries,
        nested_queries,
        packing_queries,
        relational_queries,
        runlog_queries,
        sampling_queries,
        source_queries,
        text_queries,
        tokenizer_queries,
    )
    from lexloom.plans.registry import QUERIES

    return QUERIES
