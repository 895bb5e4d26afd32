"""Schema mapper: a ``{target: source}`` mapping compiled to one projection.

Mapping values: a source name (rename; one source may feed several targets), a
list of source names (composite text), ``None`` (null placeholder), ``""`` or
``{}`` (not mapped).  A dotted target maps the inside of a struct, or of each
struct of an array.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.jsonsafe import scalar_text
from chartloom.functions.names import named

# The parts of a rendered item, in order.
ITEM_KEYS: tuple[str, ...] = ("label", "valueText", "valueNum", "valueDate", "comment")

Getter = Callable[[str], Column]


def _non_empty(col: Column) -> Column:
    return F.when(col != "", col)


def _scalar(col: Column, dtype: T.DataType) -> Column:
    """A scalar as text, null when empty; only text can be."""
    return _non_empty(col) if isinstance(dtype, T.StringType) else scalar_text(col, dtype)


def render_items(col: Column, dtype: T.DataType, keys: Sequence[str] = ITEM_KEYS) -> Column:
    """A list of objects as text, one block per object, blank line between.

    A block is ``first: a | b | c`` of the non-empty values of ``keys``, or the
    value itself when there is only one.  Zero and false count as values.
    """
    if not (isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType)):
        return F.lit(None).cast("string")
    fields = {f.name: f.dataType for f in dtype.elementType.fields}
    present = [k for k in keys if k in fields]
    if not present:
        return F.lit(None).cast("string")

    def part(item: Column, key: str) -> Column:
        kind = fields[key]
        value = item[key]
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.when(F.size(value) > 0, F.to_json(value))
        if isinstance(kind, T.StructType):
            return F.to_json(value)
        return _scalar(value, kind)

    def block(values: Column) -> Column:
        rest = F.array_join(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), " | ")
        return F.when(F.size(values) > 1, F.concat(values[0], F.lit(": "), rest)).when(F.size(values) == 1, values[0])

    values = F.transform(col, lambda item: F.array_compact(F.array(*[part(item, k) for k in present])))
    # array_join leaves out the null blocks of empty items.
    return _non_empty(F.array_join(F.transform(values, block), "\n\n"))


def _composite_value(get: Getter, fields: Mapping[str, T.DataType], name: str) -> Column:
    """One source of a composite as text; null when missing, empty or an object."""
    if name not in fields:
        return F.lit(None).cast("string")
    kind = fields[name]
    if isinstance(kind, T.ArrayType):
        return render_items(get(name), kind)
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.lit(None).cast("string")
    return _scalar(get(name), kind)


def _split(mapping: Mapping[str, Any]) -> tuple[dict[str, Any], dict[str, dict[str, Any]]]:
    """Plain targets, and the mapping inside each container of dotted targets."""
    plain: dict[str, Any] = {}
    inside: dict[str, dict[str, Any]] = {}
    for target, source in mapping.items():
        container, dot, rest = target.partition(".")
        if dot:
            inside.setdefault(container, {})[rest] = source
        else:
            plain[target] = source
    return plain, inside


def _compile(
    fields: Mapping[str, T.DataType],
    get: Getter,
    mapping: Mapping[str, Any],
    preserve_unmapped: bool,
    first_non_empty: frozenset[str],
) -> dict[str, Column]:
    plain, inside = _split(mapping)
    targets_of: dict[str, list[str]] = {}
    for target, source in plain.items():
        if isinstance(source, str) and source:
            targets_of.setdefault(source, []).append(target)

    # Where two fields end on one name the later field of the record wins.
    out: dict[str, Column] = {}
    for name in fields:
        names = targets_of.get(name) or ([name] if preserve_unmapped else [])
        out.update({n: get(name) for n in names})

    for target, source in plain.items():
        if source is None:
            out.setdefault(target, F.lit(None).cast("string"))
        elif isinstance(source, (list, tuple)):
            values = [_composite_value(get, fields, s) for s in source] or [F.lit(None).cast("string")]
            joined = F.coalesce(*values) if target in first_non_empty else _non_empty(F.concat_ws("\n", *values))
            out[target] = joined

    for container, sub_mapping in inside.items():
        nested = _nested(fields.get(container), get, container, sub_mapping, preserve_unmapped, first_non_empty)
        if nested is not None:
            out[container] = nested
    return out


def _nested(
    dtype: T.DataType | None,
    get: Getter,
    container: str,
    mapping: Mapping[str, Any],
    preserve_unmapped: bool,
    first_non_empty: frozenset[str],
) -> Column | None:
    """The mapped container, or None when it is not an object or list of objects."""

    def rebuilt(record: Column, struct: T.StructType) -> Column:
        inner = _compile(
            {f.name: f.dataType for f in struct.fields}, lambda n: record[n], mapping, preserve_unmapped, first_non_empty
        )
        return F.when(record.isNotNull(), F.struct(*[c.alias(n) for n, c in inner.items()]))

    if isinstance(dtype, T.StructType):
        return rebuilt(get(container), dtype)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return F.transform(get(container), lambda item: rebuilt(item, dtype.elementType))
    return None


def map_schema(
    df: DataFrame,
    mapping: Mapping[str, Any],
    preserve_unmapped: bool = True,
    first_non_empty: Sequence[str] = (),
) -> DataFrame:
    """Rename, compose and nest the columns of ``df`` as ``mapping`` says."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    columns = _compile(fields, lambda n: named(n), mapping, preserve_unmapped, frozenset(first_non_empty))
    return df.select(*[c.alias(n) for n, c in columns.items()])
