"""All queries of this package, the pipeline's included."""

from __future__ import annotations

import corpus_pipeline
from chartloom.llm import queries_counts, queries_native, queries_pairs, queries_text  # noqa: F401
from chartloom.llm.registry import ORACLE, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run

__all__ = ["ORACLE", "QUERIES"]
