"""Values as JSON text would carry them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.binary import base64_text
from chartloom.functions.dates import iso_text
from chartloom.functions.text import python_float_text

_NATIVE = (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.NullType)


def json_safe_column(col: Column, dtype: T.DataType) -> Column:
    """Dates as ISO text, decimals as text, bytes as base64; nested types too."""
    if not needs_conversion(dtype):
        return col
    if isinstance(dtype, T.DateType):
        return col.cast("string")
    if isinstance(dtype, T.TimestampNTZType):
        return iso_text(col)
    if isinstance(dtype, T.TimestampType):
        return iso_text(col, zoned=True)
    if isinstance(dtype, T.BinaryType):
        return base64_text(col)
    if isinstance(dtype, T.StructType):
        fields = [json_safe_column(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: json_safe_column(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: json_safe_column(v, dtype.valueType))
    return col.cast("string")


def needs_conversion(dtype: T.DataType) -> bool:
    """False when JSON writes the type as it should be already."""
    if isinstance(dtype, T.StructType):
        return any(needs_conversion(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return needs_conversion(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return needs_conversion(dtype.valueType)
    return not isinstance(dtype, _NATIVE)


def scalar_text(col: Column, dtype: T.DataType) -> Column:
    """A scalar as record text: ``True`` / ``False``, plain floats, ISO dates."""
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return python_float_text(col.cast("double"))
    if isinstance(dtype, T.TimestampNTZType):
        return iso_text(col)
    if isinstance(dtype, T.BinaryType):
        return base64_text(col)
    return col.cast("string")
