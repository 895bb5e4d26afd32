"""Identifier functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions.text import strip_space


def clean_id(col: Column) -> Column:
    """Identifier as text without quote marks and outer white space."""
    return strip_space(F.translate(col.cast("string"), "\"'", ""))


def is_numeric_id(col: Column) -> Column:
    """True for text that is digits only once trimmed."""
    return strip_space(col.cast("string")).rlike("^[0-9]+$")


def annotation_id(document: Column, annotation: Column) -> Column:
    """``<document>_<annotation>``; null when either part is null."""
    return F.concat(document.cast("string"), F.lit("_"), annotation.cast("string"))


def pseudo_id(col: Column) -> Column:
    """Stable 32 hex digit stand-in for an id: the same on a task retry."""
    return F.substring(F.sha2(col.cast("string"), 256), 1, 32)
