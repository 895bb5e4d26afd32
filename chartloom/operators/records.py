"""Whole-record helpers: JSON text, unions, ordinals, record splitting."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.jsonsafe import json_safe_column
from chartloom.functions.names import named
from chartloom.session import checkpoint_folder

_KEEP_NULLS = {"ignoreNullFields": "false"}


def only(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """Columns by exact name (a dot in a name is part of the name)."""
    return [named(n) for n in names]


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row: stable on a retry, spread evenly; maps, which can't be hashed, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(named(f.name))) if _has_map(f.dataType) else named(f.name) for f in df.schema.fields])


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return isinstance(dtype, (T.MapType, T.VariantType))


def rest_struct(df: DataFrame, without: Sequence[str]) -> Column:
    """All other columns as one struct: the footer of a request."""
    return F.struct(*only(df, [c for c in df.columns if c not in without]))


def json_safe(df: DataFrame) -> DataFrame:
    """Every column as JSON text would carry it."""
    return df.select(
        *[json_safe_column(named(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def json_column(df: DataFrame) -> Column:
    """The record as one JSON object: compact, nulls kept, non-ASCII kept."""
    fields = [json_safe_column(named(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return F.to_json(F.struct(*fields), _KEEP_NULLS)


def to_ndjson(df: DataFrame) -> DataFrame:
    """One JSON line per record in column ``value``."""
    return df.select(json_column(df).alias("value"))


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column an input lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def part_of(key: Column, parts: Column) -> Column:
    """The part (0-based) a text key belongs to: by MD5, so that any reader can tell."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % parts


def explode_records(df: DataFrame, records_col: str) -> DataFrame:
    """One row per element of an array of objects, its fields as columns."""
    names = df.schema[records_col].dataType.elementType.names
    item = F.col("_record")
    return df.select(F.explode(named(records_col)).alias("_record")).select(*[item[n].alias(n) for n in names])


def with_ordinal(df: DataFrame, order_by: Sequence[str], name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Add 0-based positions in the order of ``order_by``, without one big sort task.

    Rows are range partitioned (ties spread by a row hash), sorted per partition
    and checkpointed, so that the partitions stay what they are; a partition's
    first position is the row count of the ones before it.  Only those counts,
    one row per partition, are gathered.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    ordered = df.withColumn("_tie", row_hash(df))
    keys = [*only(df, order_by), F.col("_tie")]
    ordered = ordered.repartitionByRange(partitions, *keys) if partitions else ordered.repartitionByRange(*keys)
    ordered = (
        ordered.sortWithinPartitions(*keys)
        .select(*only(df, df.columns), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
        .checkpoint()
    )
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition: bounded by the partition count, not by the data.
    joined = ordered.join(F.broadcast(starts), "_part")
    in_partition = F.col("_row") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return joined.select((F.col("_start") + in_partition).alias(name), *only(df, df.columns))
