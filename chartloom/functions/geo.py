"""Location text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions.text import python_float_text, strip_space


def geo_string(lat: Column, lon: Column) -> Column:
    """``"<lat>,<lon>"``; null unless both are numbers."""
    lat_value, lon_value = (_number(strip_space(c.cast("string"))) for c in (lat, lon))
    return F.concat(python_float_text(lat_value), F.lit(","), python_float_text(lon_value))


def _number(text: Column) -> Column:
    """A decimal number; a type letter at its end, which a cast would take, makes it none."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$|^(?i:nan)$"), text.try_cast("double"))


def wkt_point(lon: Column, lat: Column) -> Column:
    """``POINT (lon lat)``."""
    return F.concat(
        F.lit("POINT ("), python_float_text(lon.cast("double")), F.lit(" "), python_float_text(lat.cast("double")), F.lit(")")
    )
