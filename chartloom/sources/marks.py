"""Incremental reads that survive a crash: each batch's bounds are logged before it is read.

    <path>/begun/version=4/...   the batch's bounds: from (not in it) and upto (in it)
    <path>/done/version=4/...    written once the batch's results are

A batch that was begun and not done is read again with the same bounds, whatever has
arrived meanwhile.  With a sink that overwrites by version nothing is skipped or kept twice.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.names import named


@dataclass(frozen=True)
class Batch:
    version: int
    rows: DataFrame
    low: Any  # None for the first batch
    high: Any
    again: bool  # begun before, and not done


class MarkLog:
    """The marks of one incremental read, in a folder of its own; one row a version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _last(self, state: str) -> tuple[int, str | None, str | None] | None:
        try:
            # Typed here: text that looks like a date or number would be read as one.
            rows = self.spark.read.schema("low string, high string, version int").parquet(f"{self.path}/{state}")
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return None
        row = rows.orderBy(F.desc("version")).first()
        return (row["version"], row["low"], row["high"]) if row else None

    def _write(self, state: str, version: int, low: str | None, high: str | None) -> None:
        row = self.spark.createDataFrame([(low, high)], "low string, high string")
        # Of two runs that take the same version one fails here.
        row.coalesce(1).write.mode("error").parquet(f"{self.path}/{state}/version={version}")

    def next_batch(self, df: DataFrame, key: str) -> Batch | None:
        """The rows above the last mark, or those of a batch that isn't done; None where nothing is new.

        The upper bound is the greatest key there is now; it is logged before any row is
        read.  Rows without a key come with the first batch.  Bounds are literals of the
        column's type, so the filters are pushed into the scan.  Rows that arrive later
        with a key at or below the mark are not seen: the key has to grow.
        """
        kind = df.schema[key].dataType
        begun, done = self._last("begun"), self._last("done")
        again = begun is not None and (done is None or done[0] < begun[0])
        if again:
            version, low, high = begun
        else:
            version, low = (0, None) if done is None else (done[0] + 1, done[2])
            rows = df if low is None else df.filter(named(key) > _literal(low, kind))
            high = _text(rows.agg(F.max(named(key)).alias("m")).select(_as_text(F.col("m"), kind)).first()[0])
            if high is None:
                return None
            self._write("begun", version, low, high)
        upto = named(key) <= _literal(high, kind)
        inside = upto | named(key).isNull() if low is None else upto & (named(key) > _literal(low, kind))
        return Batch(version, df.filter(inside), low, high, again)

    def done(self, batch: Batch) -> None:
        """Log that a batch's results are written."""
        self._write("done", batch.version, batch.low, batch.high)

    def high_water(self) -> str | None:
        """The mark of the last batch that is done, as text."""
        last = self._last("done")
        return None if last is None else last[2]


def _as_text(value: Column, kind: T.DataType) -> Column:
    return (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("string")


def _text(value: str | datetime.datetime | None) -> str | None:
    return None if value is None else str(value)


def _literal(text: str, kind: T.DataType) -> Column:
    """A logged mark in the column's type; moments are logged in microseconds, free of time zones."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(int(text)))
    return F.lit(text).cast(kind)


def run_batches(log: MarkLog, source: Callable[[], DataFrame], key: str, sink: Callable[[DataFrame, int], None], most: int | None = None) -> int:
    """Read, write and log batch after batch until nothing is new (or ``most`` are done); how many were.

    ``source`` gives the table as it is now; ``sink(rows, version)`` has to overwrite what an
    earlier try of the same version wrote.
    """
    n = 0
    while most is None or n < most:
        batch = log.next_batch(source(), key)
        if batch is None:
            break
        sink(batch.rows, batch.version)
        log.done(batch)
        n += 1
    return n


def versioned_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its own, and overwrites it when the batch comes again."""

    def write(rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")

    return write
