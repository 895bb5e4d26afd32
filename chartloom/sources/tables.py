"""Database tables and the stored high-water mark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_col: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 8,
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """A table (or ``(query) AS t``) over JDBC, split into ranges of a key column.

    Filters and column lists on the result are pushed to the database.  Dates of
    zero need the driver's own switch in the URL, such as
    ``zeroDateTimeBehavior=CONVERT_TO_NULL``.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), **options)
    if partition_col is not None:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        low, high = bounds
        reader = reader.options(
            partitionColumn=partition_col, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)
        )
    return reader.load()


def write_high_water(mark: DataFrame, path: str) -> None:
    """Store the one-row mark of an incremental read."""
    mark.coalesce(1).write.mode("overwrite").parquet(path)


def read_high_water(spark: SparkSession, path: str) -> Any:
    """The stored mark, or None when there is none yet (one value)."""
    try:
        row = spark.read.parquet(path).first()
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return None
    return row["high_water"] if row else None
