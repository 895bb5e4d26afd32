"""Operators on one text column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from chartloom.functions.names import named
from chartloom.functions.text import CLINICAL_SCRUB_RULES, has_term, scrub


def scrub_text(df: DataFrame, col: str = "text", rules: Iterable[tuple[str, str]] = CLINICAL_SCRUB_RULES) -> DataFrame:
    """Apply ordered substitutions to one column; a frame without it is unchanged."""
    if col not in df.columns:
        return df
    scrubbed = scrub(named(col), rules)
    return df.select(*[(scrubbed if c == col else named(c)).alias(c) for c in df.columns])


def match_text(df: DataFrame, field: str, terms: Sequence[str], every: bool = False) -> DataFrame:
    """Rows whose text has one of the terms, or with ``every`` all of them, in whole words."""
    return df.filter(has_term(named(field), terms, every))
