"""Which documents are done: ledger, upsert, high-water marks."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.ids import annotation_id
from chartloom.functions.names import named
from chartloom.operators.records import only, row_hash


def not_yet_processed(df: DataFrame, ledger: DataFrame, id_col: Column | str, ledger_col: str = "document_id") -> DataFrame:
    """Rows whose id is not in the ledger; ids compare as text, no id means not done.

    The ledger is reduced to distinct ids first, on the map side too, which is
    also the partitioning the join needs.
    """
    done = ledger.select(named(ledger_col).cast("string").alias("_id")).filter("_id IS NOT NULL").distinct()
    key = id_col if isinstance(id_col, Column) else named(id_col)
    return df.withColumn("_id", key.cast("string")).join(done, "_id", "left_anti").drop("_id")


def fetch_by_ids(df: DataFrame, ids: DataFrame, id_col: str, order_col: str | None = None) -> DataFrame:
    """All rows of the given documents.

    ``order_col`` brings a document's rows together in sequence.  The sort is by
    range of id and sequence, so a document with very many rows takes several tasks.
    """
    wanted = ids.select(named(id_col).cast("string").alias("_id")).distinct()
    rows = df.withColumn("_id", named(id_col).cast("string")).join(wanted, "_id", "left_semi")
    if order_col is not None:
        rows = rows.orderBy("_id", named(order_col))
    return rows.drop("_id")


def latest_by_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The row with the highest ``order_col`` of each key (combined map-side).

    Of rows with an equal order the one with the higher row hash wins, so that a rerun
    gives the same rows whatever the partitions.  Rows hold text, which Spark's hash
    aggregate can't keep, so they are sorted by key in each task before they shrink.
    """
    others = [c for c in df.columns if c != key]
    # Inside a struct a null order sorts first; bare, it would hide the row.
    row = F.max_by(F.struct(*only(df, others or [key])), F.struct(named(order_col), row_hash(df))).alias("_row")
    latest = df.groupBy(named(key).alias("_key")).agg(row)
    # The key is the grouping column itself: whoever needs keys only gets a plain
    # distinct, without the rows.
    return latest.select(*[(F.col("_key") if c == key else F.col("_row")[c]).alias(c) for c in df.columns])


def upsert(target: DataFrame, updates: DataFrame, key: str, order_col: str) -> DataFrame:
    """Target rows without an update, and the last update of each key."""
    fresh = latest_by_key(updates, key, order_col)
    kept = target.join(fresh.select(named(key)), key, "left_anti").select(*only(target, target.columns))
    return kept.unionByName(fresh, allowMissingColumns=True)


def ledger_rows(annotations: DataFrame, document: Column, annotation: Column) -> DataFrame:
    """Ledger rows ``id, document_id`` of annotations that were stored."""
    return annotations.select(annotation_id(document, annotation).alias("id"), document.cast("string").alias("document_id"))


def incremental(df: DataFrame, key: str, last: Any = None) -> tuple[DataFrame, DataFrame]:
    """(rows above the high-water mark, one-row frame ``high_water`` with the new mark).

    The new mark is read first, here, and the rows end at it: rows that arrive while a
    table is read are left for the next run, never skipped.  Marks are literals of the
    column's type, so the filter is pushed into the scan.  Without ``last`` all rows up
    to the mark are taken, and those without a key.
    """
    kind = df.schema[key].dataType

    def literal(value: Any) -> Column:
        # A wall-clock time goes in as text: a literal would be taken for a moment in
        # the session's time zone.
        return F.lit(str(value) if isinstance(value, datetime.datetime) else value).cast(kind)

    rows = df if last is None else df.filter(named(key) > literal(last))
    newest = rows.agg(F.max(named(key)).cast("string" if isinstance(kind, T.TimestampType) else kind).alias("m")).first()["m"]
    mark = literal(last if newest is None else newest)
    if newest is not None:
        upto = named(key) <= mark
        rows = rows.filter(upto | named(key).isNull() if last is None else upto)
    return rows, df.sparkSession.range(1).select(mark.alias("high_water"))


def limit_batch(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of a run, in a stated order."""
    return df.orderBy(*order_by).limit(n)


def ingest_counts(ledger: DataFrame, folder_col: str = "folder") -> DataFrame:
    """Files per folder, and in total in the row with a null folder."""
    return ledger.rollup(folder_col).agg(F.count("*").alias("n_files"))
