"""Casts to the common document schema and by column name."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.dates import EPOCH_MILLIS, parse_first
from chartloom.functions.geo import geo_string
from chartloom.functions.names import named

# The date notations of the common schema.  No text fits two of them but
# digits, which are a date of eight digits before they are a number of milliseconds.
DATE_FORMATS: tuple[str, ...] = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyyMMdd",
    "yyyy-MM-dd'T'HH",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "HH:mm:ss.SSSXXX",
    "HH:mm",
    "yyyy/MM/dd",
    "dd/MM/yyyy",
    "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "HHmmss.SSSX",
    "HHmmssX",
    "'T'HHmmss.SSSX",
    "HH:mm:ss",
    "HH:mm.ss",
    "HH:mm.ssZ",
    EPOCH_MILLIS,
)

# What the name of a date column ends with.
DATE_NAME_ENDINGS: tuple[str, ...] = (
    "date", "_datetime", "_dt", "_dttm", "_dat", "_datime", "_time", "_ts", "_timestamp", "time", "when", "dt",
    "dttm", "timestamp", "created", "updated", "modified", "inserted", "recorded", "logged", "entered", "performed",
    "signed", "cosigned", "completed", "admit", "discharge", "visit", "appointment", "service", "start", "end",
    "effective", "expiry", "validfrom", "validto", "close",
)
DATE_NAME = re.compile("(?:" + "|".join(DATE_NAME_ENDINGS) + ")$", re.IGNORECASE)


def _cast(col: Column, dtype: T.DataType, kind: str, formats: Sequence[str]) -> Column:
    if kind == "date":
        return parse_first(col, formats) if isinstance(dtype, T.StringType) else col.cast("timestamp_ntz")
    if kind in ("keyword", "text"):
        return col.cast("string")
    if kind in ("integer", "boolean"):
        return col.try_cast("int" if kind == "integer" else "boolean")
    if kind == "scaled_float":
        return col.try_cast("decimal(18,2)")
    if kind == "geo_point":
        if isinstance(dtype, T.StructType):
            return geo_string(col["lat"], col["lon"])
        text = col.cast("string")
        return geo_string(F.substring_index(text, ",", 1), F.substring_index(text, ",", -1))
    if kind == "nested":
        return col
    raise ValueError(f"unknown common type {kind!r}")


def cast_common(df: DataFrame, type_map: Mapping[str, str], formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Columns to their common type; what cannot be read is null.

    A time of day alone is one of 1970-01-01; a time with an offset becomes the wall
    clock of the session's time zone.
    Types: date, keyword, text, integer, boolean, scaled_float (factor 100),
    geo_point and nested.
    """
    return df.select(
        *[
            (_cast(named(f.name), f.dataType, type_map[f.name], formats) if f.name in type_map else named(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def cast_dates_by_name(df: DataFrame, name_pattern: re.Pattern[str] = DATE_NAME, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Text columns whose name looks like a date column become timestamps."""
    dated = {f.name: "date" for f in df.schema.fields if isinstance(f.dataType, T.StringType) and name_pattern.search(f.name)}
    return cast_common(df, dated, formats)


def with_keyword(df: DataFrame, col: str, max_chars: int = 256) -> DataFrame:
    """Add ``<col>_keyword``: the text itself unless it is too long for a keyword."""
    text = named(col)
    return df.withColumn(f"{col}_keyword", F.when(F.length(text) <= max_chars, text))
