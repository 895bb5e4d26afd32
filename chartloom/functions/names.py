"""Columns by exact name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of that very name: a dot in it (``nlp.cui``) is part of the name."""
    return F.col(f"`{name}`")
