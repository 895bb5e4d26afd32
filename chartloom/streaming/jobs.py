"""Streaming ingest, dedup, transform with a failure route, running cohort counts.

Every query resumes from its checkpoint location, and ``availableNow`` drains what
is there and stops.  A batch is written to a folder named by its id, so a batch
that runs again after a lost driver replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chartloom.functions.names import named
from chartloom.operators.cohort import epoch_seconds, split_affirmed
from chartloom.plans.transform import Flow
from chartloom.sources.records import Schema

Routed = tuple[DataFrame, DataFrame | None]


def stream_documents(
    spark: SparkSession,
    path: str,
    schema: Schema,
    fmt: str = "parquet",
    max_files: int | None = None,
    max_bytes: str | None = None,
    **options: str,
) -> DataFrame:
    """A folder of files as a stream, with a bound on what one batch takes in."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)


def stream_dedup(df: DataFrame, id_col: str, ts_col: str | None = None, delay: str | None = None) -> DataFrame:
    """Each document id once.

    With ``ts_col`` and ``delay`` the remembered ids are dropped when the watermark
    passes them; without, all ids are remembered.
    """
    if ts_col is None or delay is None:
        return df.dropDuplicates([id_col])
    return df.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([id_col])


def run_stream(
    df: DataFrame,
    apply: Callable[[DataFrame], Routed],
    sink: str,
    failures: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Run a batch transform over a stream and write good and failed rows apart.

    What the stream itself works out, such as keyed state, is worked out once and kept for
    both writes.  They compute ``apply`` twice; see ``run_tagged`` for costly ones.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        good, failed = apply(batch)
        if failed is None:
            good.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
            return
        batch.persist()
        try:
            good.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
            failed.write.mode("overwrite").parquet(f"{failures}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_tagged(
    df: DataFrame, apply: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Run a transform whose result holds good and failed rows (``error``) together.

    For steps that must run once per record, such as a service call: one write per
    batch.  Take the stored rows apart with ``plans.split_failed``.
    """
    return run_stream(df, lambda batch: (apply(batch), None), sink, "", checkpoint, available_now)


def run_flow(df: DataFrame, flow: Flow, sink: str, failures: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a chain of steps over a stream."""

    def apply(batch: DataFrame) -> Routed:
        result = flow.run(batch)
        return result.good, result.failures

    return run_stream(df, apply, sink, failures, checkpoint, available_now)


def read_batches(spark: SparkSession, sink: str) -> DataFrame:
    """What ``run_stream`` wrote so far."""
    return spark.read.parquet(sink).drop("batch_id")


def stream_cohort(
    annotations: DataFrame,
    doc2ptt: DataFrame,
    cui_col: str = "cui",
    doc_col: str = "docid",
    ts_col: str = "timestamp",
    meta_col: str = "meta_anns",
) -> DataFrame:
    """Running ``cui, patient, n, first_seen`` over a stream of annotations (update mode).

    ``doc2ptt`` is a static table; Spark joins every batch to it.
    """
    mentions, _ = split_affirmed(annotations, meta_col)
    rows = mentions.select(
        named(doc_col).cast("string").alias("doc"),
        named(cui_col).alias("cui"),
        F.nullif(epoch_seconds(named(ts_col), annotations.schema[ts_col].dataType), F.lit(0)).alias("s"),
    )
    known = doc2ptt.select(named(doc_col).cast("string").alias("doc"), "patient")
    return rows.join(known, "doc").groupBy("cui", "patient").agg(F.count("*").alias("n"), F.min("s").alias("first_seen"))


def write_cohort_batch(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write the counts that changed per batch; the newest batch of a key is its value."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
