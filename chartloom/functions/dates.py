"""Date functions.  Wall-clock values are TIMESTAMP_NTZ, free of the session zone."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
EPOCH_MILLIS = "epoch_millis"


def _from_millis(col: Column) -> Column:
    return F.timestamp_add("MILLISECOND", col, F.expr(_EPOCH))


def parse_date(col: Column, fmt: str = "yyyy-MM-dd", *, epoch_millis: bool = False, epoch_default: bool = False) -> Column:
    """Date value from epoch milliseconds or from text in ``fmt``.

    Null, empty and the word ``null`` are "no date": null, or 1970-01-01 with
    ``epoch_default``.  Text that does not parse is null either way; test it with
    ``is_bad_date``.
    """
    if epoch_millis:
        parsed = _from_millis(col.cast("bigint"))
    else:
        parsed = F.try_to_timestamp(col.cast("string"), F.lit(fmt)).cast("timestamp_ntz")
    if epoch_default:
        parsed = F.when(is_no_date(col), F.expr(_EPOCH)).otherwise(parsed)
    return parsed


def is_no_date(col: Column) -> Column:
    """True where the source says there is no date at all."""
    return col.isNull() | col.cast("string").isin("", "null")


def is_bad_date(col: Column, parsed: Column) -> Column:
    """True where a date was given but did not parse."""
    return ~is_no_date(col) & parsed.isNull()


_DIGITS = {"y": 4, "M": 2, "d": 2, "H": 2, "m": 2, "s": 2, "S": 3}
_ZONES = {"XXX": r"(?:Z|[+-]\d{2}:\d{2})", "X": r"(?:Z|[+-]\d{2}(?:\d{2})?)", "Z": r"[+-]\d{4}"}


def _shape(fmt: str) -> str | None:
    """What text in a format of digits and offsets looks like; None for formats with names."""
    out = ""
    for part in re.finditer(r"'(?P<quoted>[^']*)'|(?P<field>(?P<letter>[A-Za-z])(?P=letter)*)|(?P<mark>.)", fmt):
        if part["field"] in _ZONES:
            out += _ZONES[part["field"]]
        elif part["field"]:
            if _DIGITS.get(part["letter"]) != len(part["field"]):
                return None
            out += rf"\d{{{len(part['field'])}}}"
        else:
            out += re.escape(part["quoted"] or part["mark"])
    return f"^{out}$"


def parse_first(col: Column, formats: Sequence[str]) -> Column:
    """First format that parses; ``epoch_millis`` takes a run of digits."""
    text = col.cast("string")
    tries = []
    for fmt in formats:
        if fmt == EPOCH_MILLIS:
            digits = F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))
            tries.append(_from_millis(digits))
        else:
            # A parser that fails throws inside; the shape test spares most of that.
            shape = _shape(fmt)
            candidate = text if shape is None else F.when(text.rlike(shape), text)
            tries.append(F.try_to_timestamp(candidate, F.lit(fmt)).cast("timestamp_ntz"))
    return F.coalesce(*tries)


def ts_to_int(col: Column) -> Column:
    """``yyyyMMddHHmmss`` as a whole number, 0 when there is no date."""
    date_part = F.year(col) * 10000 + F.month(col) * 100 + F.dayofmonth(col)
    time_part = F.hour(col) * 10000 + F.minute(col) * 100 + F.second(col)
    return F.coalesce(date_part.cast("bigint") * 1000000 + time_part, F.lit(0).cast("bigint"))


def age_and_death(birth: Column, death: Column, as_of: Column, limit: bool = False, signed: bool = False) -> tuple[Column, Column]:
    """Age in calendar years and the death date that goes with it.

    The living are aged at ``as_of``.  With ``limit``, a living person of 100 or
    more gets age -1 and ``as_of`` as death date.  ``signed`` keeps the minus of a
    death before the birth.
    """
    years = F.year(F.coalesce(death, as_of)) - F.year(birth)
    if not signed:
        years = F.abs(years)
    if not limit:
        return years, death
    over = death.isNull() & (years >= 100)
    return F.when(over, F.lit(-1)).otherwise(years), F.when(over, as_of).otherwise(death)


def iso_text(col: Column, zoned: bool = False) -> Column:
    """ISO text: no fraction when it is zero, six digits otherwise."""
    text = F.replace(col.cast("string"), F.lit(" "), F.lit("T"))
    text = F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
    return F.concat(text, F.date_format(col, "xxx")) if zoned else text
