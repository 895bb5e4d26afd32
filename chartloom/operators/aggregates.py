"""Aggregations over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.ids import is_numeric_id
from chartloom.functions.names import named
from chartloom.functions.text import strip_space
from chartloom.operators.records import only
from chartloom.session import checkpoint_folder


def ids_csv(
    df: DataFrame,
    field: str,
    order_col: str | Sequence[str],
    batch_cols: Sequence[str] = (),
    max_ids: int = 100_000,
    distinct: bool = False,
) -> DataFrame:
    """Numeric ids as comma-separated text: ``ids_csv, ids_count, ids_len`` per batch.

    Ids stand in the order of ``order_col``.  A batch is cut into slices of ``max_ids``
    ids by their counted positions, so that the text of a big batch is several
    bounded rows (``slice``) and not one; what the order's values are doesn't matter.
    Only digits pass, repeats stay unless ``distinct``; a repeat is kept at its first
    position.

    Rows are range partitioned by batch and order, and positions counted from each
    partition's first row on, so that a batch with a third of all rows is no task's alone.
    """
    orders = [order_col] if isinstance(order_col, str) else list(order_col)
    text = strip_space(named(field).cast("string"))
    rows = df.filter(is_numeric_id(named(field))).select(
        *only(df, batch_cols), F.struct(*[named(c) for c in orders]).alias("_pos"), text.alias("_id")
    )
    if distinct:
        rows = rows.groupBy(*batch_cols, "_id").agg(F.min("_pos").alias("_pos"))
    keys = [*only(rows, batch_cols), F.col("_pos"), F.col("_id")]
    checkpoint_folder(df.sparkSession)
    dealt = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy(*batch_cols, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*batch_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*only(counts, batch_cols), "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*batch_cols, "_part").orderBy("_pos", "_id")
    numbered = dealt.withColumn("_nth", F.row_number().over(inside) - 1)
    on = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in [*batch_cols, "_part"]]
    placed = numbered.alias("a").join(starts.alias("b"), on).select(
        *[F.col(f"a.`{c}`") for c in batch_cols], "_id", (F.col("_start") + F.col("_nth")).alias("_at")
    )
    placed = placed.withColumn("slice", F.floor(F.col("_at") / max_ids))
    listed = placed.groupBy(*only(placed, batch_cols), "slice").agg(
        F.expr("listagg(_id, ',') WITHIN GROUP (ORDER BY _at)").alias("ids_csv"), F.count("*").alias("ids_count")
    )
    return listed.withColumn("ids_len", F.length("ids_csv").cast("bigint"))


def json_records(df: DataFrame, json_col: str, field: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per object of a JSON list, or of the list under ``records``: the kept columns, ``position``, the field as text.

    Each element is taken for itself: a number, a text or a list among the objects is
    passed over and leaves the others whole.  ``position`` counts all elements from 0.
    The field is the text it is written as (``14.0`` stays such); null where it is null or
    missing.  Text that is neither list nor such an object, isn't JSON, or is null holds
    no records.  ``ids_csv`` takes the result, ordered by the kept columns and ``position``.
    """
    text = named(json_col)
    value = F.try_parse_json(text)
    # The kinds come from the parsed value, the texts from the JSON itself: parsing drops a number's zeros.
    bare = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(F.ltrim(text).startswith("["), F.array().cast("array<variant>")))
    kinds = F.coalesce(bare, F.try_variant_get(value, "$.records", "array<variant>"))
    listed = F.from_json(text, "array<string>")
    inside = F.from_json(text, "records array<string>")["records"]
    raws = F.when(bare.isNotNull(), listed).otherwise(inside)
    rows = df.select(*only(df, keep), kinds.alias("_kinds"), F.posexplode(raws).alias("position", "_raw"))
    kind = F.schema_of_variant(F.get("_kinds", F.col("position")))
    # A value with a key twice can't be parsed as a whole; then an element's first character tells.
    is_object = F.coalesce(kind.startswith("OBJECT"), F.col("_raw").startswith("{"))
    # Of a key that comes twice the last value counts.
    held = F.from_json("_raw", T.StructType([T.StructField(field, T.StringType())]))
    return rows.filter(is_object).select(*only(rows, keep), "position", held[field].alias(field))


def terms(df: DataFrame, field: str, size: int | None = None) -> DataFrame:
    """Rows per value, most first: ``key, doc_count``; ``size`` is a top-k report."""
    counts = df.filter(named(field).isNotNull()).groupBy(named(field).alias("key")).agg(F.count("*").alias("doc_count"))
    ordered = counts.orderBy(F.desc("doc_count"), "key")
    return ordered if size is None else ordered.limit(size)


def bucket_ledger(buckets: DataFrame) -> DataFrame:
    """One ledger row ``<key>_1`` per bucket."""
    return buckets.select(F.concat(F.col("key").cast("string"), F.lit("_1")).alias("id"), F.col("key").cast("string").alias("document_id"))


def with_metrics(df: DataFrame, name: str, error: Column | None = None) -> tuple[DataFrame, Observation]:
    """Count records and errors while another action runs, at no extra pass."""
    seen = Observation(name)
    errors = F.count_if(error) if error is not None else F.lit(0).cast("bigint")
    return df.observe(seen, F.count(F.lit(1)).alias("record_count"), errors.alias("error_count")), seen
