"""Streaming queries: a table's files as the stream, drained, and read back.

State, checkpoints and output go to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import map_schema, split_affirmed
from chartloom.plans import Flow, NlpRequests, TextScrub
from chartloom.streaming import (
    read_batches,
    run_flow,
    run_stream,
    stream_assemble_blobs,
    stream_cohort,
    stream_dedup,
    stream_documents,
    write_cohort_batch,
)
from workload import query
from workload.assembly import PARTS_SQL
from workload.casting import scrub_sql
from workload.cohort import ANNOTATIONS_SQL
from workload.inputs import doc2ptt, shape_annotations, shape_parts, table
from workload.scratch import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def stream(spark: SparkSession, sf: str, name: str, max_files: int = 100) -> DataFrame:
    """The table's file, or the files of its folder; a pattern, since the stream takes no path of one file."""
    return stream_documents(spark, f"{sf}/{name}.[p]arquet", table(spark, sf, name).schema, max_files=max_files)


@query("stream_mapped", """SELECT event_id AS id, user_id AS patient, event_type AS kind, value || chr(10) || props AS summary FROM events""")
def stream_mapped(spark: SparkSession, sf: str) -> DataFrame:
    mapping = {"id": "event_id", "patient": "user_id", "kind": "event_type", "summary": ["value", "props"]}
    out = scratch(spark, "mapped")
    rows = map_schema(stream(spark, sf, "events"), mapping, preserve_unmapped=False)
    run_stream(rows, lambda batch: (batch, None), f"{out}/good", f"{out}/failed", f"{out}/state").awaitTermination()
    return read_batches(spark, f"{out}/good")


@query("stream_routed_failures", f"WITH {ANNOTATIONS_SQL} SELECT ann_id, 'no Time' AS error FROM checked WHERE is_patient AND is_present AND NOT has_time")
def stream_routed(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "routed")
    rows = shape_annotations(stream(spark, sf, "events"))
    run_stream(rows, split_affirmed, f"{out}/good", f"{out}/failed", f"{out}/state").awaitTermination()
    return read_batches(spark, f"{out}/failed").select("ann_id", "error")


@query("stream_flow", f"""SELECT CAST(doc_id AS VARCHAR) AS id, {scrub_sql('text')} AS text, lang FROM documents
WHERE length({scrub_sql('text')}) >= 200""")
def stream_flow(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "flow")
    rows = stream(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("_id"), "text", "lang")
    flow = Flow([TextScrub(text_col="text"), NlpRequests(min_chars=200)])
    run_flow(rows, flow, f"{out}/good", f"{out}/failed", f"{out}/state").awaitTermination()
    return read_batches(spark, f"{out}/good").select("id", "text", "footer.lang")


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_unique(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "dedup")
    rows = stream_dedup(stream(spark, sf, "events").select("user_id"), "user_id")
    run_stream(rows, lambda batch: (batch, None), f"{out}/good", f"{out}/failed", f"{out}/state").awaitTermination()
    return read_batches(spark, f"{out}/good")


@query("stream_dedup_watermark", "SELECT DISTINCT user_id FROM events")
def stream_unique_late(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "dedup-late")
    rows = stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    unique = stream_dedup(rows, "user_id", "ts", "400 days")
    run_stream(unique, lambda batch: (batch, None), f"{out}/good", f"{out}/failed", f"{out}/state").awaitTermination()
    return read_batches(spark, f"{out}/good").select("user_id")


@query("stream_cohort", f"WITH {ANNOTATIONS_SQL} SELECT * FROM facts")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "cohort")
    counts = stream_cohort(shape_annotations(stream(spark, sf, "events")), doc2ptt(spark, sf))
    write_cohort_batch(counts, f"{out}/counts", f"{out}/state").awaitTermination()
    batches = spark.read.parquet(f"{out}/counts")
    newest = batches.groupBy("cui", "patient").agg(F.max_by(F.struct("n", "first_seen"), "batch_id").alias("v"))
    return newest.select("cui", "patient", "v.n", "v.first_seen")


@query("stream_assembled", f"""WITH {PARTS_SQL},
arrived AS (SELECT *, n - CASE WHEN doc_id % 17 = 0 AND n >= 3 THEN 1 ELSE 0 END AS here FROM fate)
SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest, CAST(n AS BIGINT) AS blob_parts FROM arrived
WHERE doc_id % 37 <> 0 AND (doc_id % 43 <> 0 OR n < 2) AND doc_id % 19 <> 0 AND doc_id % 41 <> 0 AND doc_id % 23 <> 0 AND here = n""")
def stream_assembled(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "assembled")
    parts = shape_parts(stream(spark, sf, "documents")).filter("blob_sequence_num IS NOT NULL")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        whole = stream_assemble_blobs(parts, "id", "blob_sequence_num", "binarydoc", "n_parts")
        run_stream(
            whole, lambda b: (b.filter("error IS NULL"), b.filter("error IS NOT NULL")), f"{out}/good", f"{out}/failed", f"{out}/state"
        ).awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return read_batches(spark, f"{out}/good").select("id", F.md5("payload").alias("digest"), "blob_parts")


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by ``lot``, one of three, to come a batch each: a document's parts are dealt over them, its first part
    comes again in the second, and what damage ``shape_parts`` does is there.  Texts are cut up once for all lots."""
    # A document without numbers whose first part is there twice has a part too many for its total.
    parts = shape_parts(table(spark, sf, "documents")).filter("NOT (id % 37 = 0 AND id % 19 = 0)")
    lot, again = F.expr("(ordinal % 1000000) div 2") % 3, F.expr("(ordinal % 1000000) = 0 AND id % 19 <> 0")
    return parts.withColumn("lot", F.explode(F.when(again, F.array(lot, F.lit(1))).otherwise(F.array(lot)))).persist(StorageLevel.DISK_ONLY)


_ARRIVED = f"""WITH {PARTS_SQL},
arrived AS (
  SELECT *, CASE WHEN doc_id % 37 <> 0 AND doc_id % 19 = 0 THEN 'duplicate sequence number'
    WHEN doc_id % 17 = 0 AND n >= 3 THEN 'waits' WHEN doc_id % 43 = 0 AND doc_id % 37 <> 0 AND n >= 2 THEN 'sequence number on some parts only'
    WHEN doc_id % 41 = 0 AND NOT (doc_id % 23 = 0 AND n = 1) THEN 'missing payload in a part'
    WHEN doc_id % 23 = 0 THEN 'invalid base64 in a part' END AS fault
  FROM fate WHERE NOT (doc_id % 37 = 0 AND doc_id % 19 = 0))"""


def _assembled(spark: SparkSession, sf: str, **options: object) -> str:
    """Each lot is written in the tasks that read it; the stream goes on from its checkpoint and takes all its files as one batch."""
    out, path = scratch(spark, "arrivals"), scratch(spark, "arriving")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    dealt = _arrivals(spark, sf)
    try:
        for lot in range(3):
            arrived = dealt.filter(F.col("lot") == lot).drop("lot")
            arrived.write.mode("append").parquet(path)
            rows = stream_documents(spark, path, arrived.schema)
            whole = stream_assemble_blobs(rows, "id", "blob_sequence_num", "binarydoc", "n_parts", ordinal_col="ordinal", **options)
            run_stream(
                whole, lambda b: (b.filter("error IS NULL"), b.filter("error IS NOT NULL")), f"{out}/good", f"{out}/failed", f"{out}/state"
            ).awaitTermination()
    finally:
        dealt.unpersist()
        spark.conf.set(STORE, before)
    return out


@query("stream_batches_assembled", f"""{_ARRIVED}
SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest, CAST(n AS BIGINT) AS blob_parts FROM arrived WHERE fault IS NULL""")
def stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    good = read_batches(spark, f"{_assembled(spark, sf)}/good")
    return good.select("id", F.md5("payload").alias("digest"), "blob_parts")


@query("stream_batches_failed", f"""{_ARRIVED}
SELECT CAST(doc_id AS VARCHAR) AS id, fault AS error FROM arrived WHERE fault IS NOT NULL AND fault <> 'waits'""")
def stream_batches_failed(spark: SparkSession, sf: str) -> DataFrame:
    failed = read_batches(spark, f"{_assembled(spark, sf)}/failed")
    return failed.filter("error <> 'part arrived after the document was closed'").select("id", "error")


@query("stream_batches_kept_first", f"""{_ARRIVED}
SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest FROM arrived
WHERE coalesce(fault, '') IN ('', 'duplicate sequence number') AND NOT (doc_id % 17 = 0 AND n >= 3)
  AND (doc_id % 43 <> 0 OR n < 2 OR doc_id % 37 = 0) AND doc_id % 41 <> 0 AND doc_id % 23 <> 0""")
def stream_batches_kept(spark: SparkSession, sf: str) -> DataFrame:
    good = read_batches(spark, f"{_assembled(spark, sf, dup='keep_first')}/good")
    return good.filter("cast(id as long) % 41 <> 0 AND cast(id as long) % 23 <> 0").select("id", F.md5("payload").alias("digest"))
