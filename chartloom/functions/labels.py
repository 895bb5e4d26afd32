"""Label functions for patient attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_label(col: Column, missing: str = "unknown") -> Column:
    """Lower case with ``-`` and ``_`` as spaces; null becomes ``missing``."""
    return F.coalesce(F.translate(F.lower(col.cast("string")), "-_", "  "), F.lit(missing))


def title_case(col: Column) -> Column:
    """Capital after every non-letter, small otherwise (``o'neil`` -> ``O'Neil``)."""
    runs = F.regexp_extract_all(col, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(0))

    def capitalise(run: Column) -> Column:
        return F.concat(F.upper(F.substring(run, 1, 1)), F.lower(run.substr(F.lit(2), F.length(run))))

    return F.array_join(F.transform(runs, capitalise), "")


def norm_gender(col: Column) -> Column:
    """``Male``, ``Female`` or ``Unknown`` from words, initials or 1 / 2."""
    code = F.lower(col.cast("string"))
    return F.when(code.isin("male", "1", "m"), "Male").when(code.isin("female", "2", "f"), "Female").otherwise("Unknown")
