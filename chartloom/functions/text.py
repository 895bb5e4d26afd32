"""Text functions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered (pattern, replacement) scrub rules.  All are applied
# without regard to case, and the order is part of the result: the second rule
# takes away every letter m, so later patterns that need one never match.
CLINICAL_SCRUB_RULES: tuple[tuple[str, str], ...] = (
    (r"PEf", "ABCD100"),
    (r"\d\d\d?F|M", ""),
    (r"RFH|CFH|BA|Barnet|BARNET", ""),
    (r"IMT|CST|AHP|CNS", ""),
    (r"GMC:\s*\d{7}", ""),
    (r"MCIRL:\s*\d{6}", ""),
    (r"NHS\s*Number:\s*\d{3}\s*\d{3}\s*\d{4}", ""),
    (r"(https?:\/\/)?www\.royalfree\.nhs\.uk[^\s]*", ""),
    (r"UCLH|UCH|NMUH|BGH|NUH", ""),
)

# Unicode-aware classes and case folding.
_FLAGS = "(?iU)"
_WORDS = re.compile(r"[A-Za-z]+(\|[A-Za-z]+)+")


def _quick(pattern: str) -> str:
    """The same pattern; a choice of plain words first looks at one letter.

    That rejects most positions of a text in one step, which halves the cost.
    """
    if not _WORDS.fullmatch(pattern):
        return pattern
    first = "".join(sorted({word[0] for word in pattern.split("|")}))
    return f"(?=[{first}])(?:{pattern})"


def scrub(col: Column, rules: Iterable[tuple[str, str]] = CLINICAL_SCRUB_RULES) -> Column:
    """Apply the substitutions in order as one expression; null stays null."""
    for pattern, replacement in rules:
        col = F.regexp_replace(col, F.lit(_FLAGS + _quick(pattern)), F.lit(replacement))
    return col


def strip_space(col: Column) -> Column:
    """Trim all Unicode white space (tabs and line ends too), not only U+0020."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def is_blank(col: Column) -> Column:
    """Null, empty, or white space only."""
    return col.isNull() | ~col.rlike(r"(?U)\S")


def file_stem(col: Column) -> Column:
    """File name without its last extension; a name without a dot is kept."""
    return F.regexp_replace(col, r"\.[^.]*$", "")


def has_term(col: Column, terms: Sequence[str], every: bool = False) -> Column:
    """True when one of ``terms`` (all of them with ``every``) occurs in whole words, case ignored.

    Terms are taken apart as the text is: ``x-ray`` and ``chest pain`` are two words
    each, which have to follow one another.  A term without a word matches nothing.
    """
    marks = r"[^\p{L}\p{N}]+"

    def spaced(text: Column) -> Column:
        return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), marks, " ")

    words = spaced(col)
    found = [F.contains(words, spaced(F.lit(t))) & (spaced(F.lit(t)) != " ") for t in terms]
    return reduce(lambda a, b: a & b if every else a | b, found, F.lit(every))


def python_float_text(col: Column) -> Column:
    """A double as text in plain notation between 1e-4 and 1e16.

    The JVM goes to ``E`` notation outside 1e-3..1e7; record text uses the wider
    plain range, and ``1e-05`` / ``1e+16`` style beyond it.
    """
    size = F.abs(col)

    def plain(decimal_type: str) -> Column:
        return F.regexp_replace(col.try_cast(decimal_type).cast("string"), r"(\.\d+?)0+$", "$1")

    raw = col.cast("string")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    exponent = F.substring_index(raw, "E", -1)
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    digits = F.regexp_replace(exponent, "^-", "")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    scientific = F.concat(mantissa, F.lit("e"), sign, padded)
    # Ordinary numbers take the first branch, at the cost of two comparisons.
    return (
        F.when((size >= 1e-3) & (size < 1e7) | (size == 0), raw)
        .when(F.isnan(col), "nan")
        .when(size == float("inf"), F.when(col > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-4) & (size < 1e-3), plain("decimal(38,24)"))
        .when((size >= 1e7) & (size < 1e16), plain("decimal(38,16)"))
        .otherwise(scientific)
    )
