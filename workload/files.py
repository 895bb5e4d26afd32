"""Queries on what lies in files: trees of documents, selection by name, written parts and failures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.operators import (
    PatientColumns,
    assemble_blobs,
    nameless_patients,
    patient_table,
    request_batches,
    resolve_payload,
    to_nlp_request,
    with_metrics,
)
from chartloom.sources import read_documents, read_json_records, read_ndjson, write_failures, write_split
from workload import query
from workload.assembly import payloads
from workload.cohort import _as_of
from workload.inputs import PARTS_SQL, PATIENTS_SQL, parts, patients, table
from workload.scratch import scratch


def _put(df: DataFrame, name: str) -> str:
    """Write each row's ``content`` to the file ``path`` of a new folder, in the tasks."""
    root = scratch(df.sparkSession, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                system, place = fs.FileSystem.from_uri(f"{root if ':' in root else 'file://' + root}/{path}")
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(bytes(content))
            yield batch[["path"]]

    df.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string").count()
    return root


def _day(doc: Column) -> Column:
    """A folder by date for most documents, another for every ninth."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (doc % 10).cast("int")), "yyyy/MM/dd")
    return F.when(doc % 9 == 0, "misc").otherwise(day)


def _tree(spark: SparkSession, sf: str) -> str:
    """A file for each document, and in each folder a table of metadata that leaves out some and has one too many."""
    docs = table(spark, sf, "documents").withColumn("day", _day(F.col("doc_id")))
    name = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".csv.txt"))).otherwise(
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")))
    files = docs.select(F.concat_ws("/", "day", name).alias("path"), F.col("text").alias("content"))
    lines = F.array_join(F.array_sort(F.collect_list(F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("doc"), F.col("doc_id"), F.lit("|"), F.col("lang"))))), "\n")
    metadata = docs.groupBy("day").agg(F.concat(F.lit("file_name_id_no_ext|dept\nnofile|x\n"), lines, F.lit("\n")).alias("content"))
    return _put(files.unionByName(metadata.select(F.concat("day", F.lit("/metadata.csv")).alias("path"), "content")), "tree")


_DAY = "strftime(DATE '2024-01-01' + CAST(doc_id % 10 AS INT), '%Y/%m/%d')"


@query("documents_with_metadata", f"""
SELECT {_DAY} AS day, 'doc' || doc_id AS id, lang AS dept, md5(text) AS digest FROM documents
WHERE doc_id % 9 <> 0 AND doc_id % 11 <> 0 AND doc_id % 4 <> 0""")
def documents_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_documents(spark, _tree(spark, sf), metadata_schema="file_name_id_no_ext string, dept string")
    return rows.select(F.right("folder", F.lit(10)).alias("day"), F.col("file_name_id_no_ext").alias("id"), "dept", F.md5(F.unbase64("binarydoc")).alias("digest"))


@query("documents_files_only", f"""
SELECT {_DAY} AS day, 'doc' || doc_id AS id, md5(text) AS digest, TRUE AS named_by_hash FROM documents
WHERE doc_id % 9 <> 0 AND doc_id % 11 <> 0 AND doc_id % 3 <> 0""")
def documents_files_only(spark: SparkSession, sf: str) -> DataFrame:
    root = _tree(spark, sf)
    whole = read_documents(spark, root, "files_only")
    done = whole.filter(F.regexp_extract("document_Id", r"(\d+)", 1).cast("long") % 3 == 0).select("folder", F.col("document_Id").alias("document_id"))
    rest = read_documents(spark, root, "files_only", pseudo=True, ledger=done)
    return rest.select(
        F.right("folder", F.lit(10)).alias("day"), F.col("document_Id").alias("id"), F.md5(F.unbase64("binarydoc")).alias("digest"),
        F.col("document_Pseudo_Id").rlike("^[0-9a-f]{32}$").alias("named_by_hash"),
    )


def _json_files(spark: SparkSession, sf: str) -> str:
    """A file a document: one object, a list of two, or no JSON; some are named as annotations."""
    doc = F.col("doc_id")
    one = F.to_json(F.struct("doc_id", "lang"))
    content = F.when(doc % 5 == 0, F.concat(one, F.lit("]"))).when(doc % 2 == 0, F.concat(F.lit("[\n"), one, F.lit(",\n "), one, F.lit("]"))).otherwise(one)
    content = F.when(doc % 5 == 0, F.lit('[{"doc_id": ')).otherwise(content)
    path = F.concat(F.lit("d"), doc % 3, F.when(doc % 7 == 0, "/medical_ann_").otherwise("/plain_"), doc, F.lit(".json"))
    return _put(table(spark, sf, "documents").select(path.alias("path"), content.alias("content")), "json")


@query("json_files_by_name", """
SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS copies FROM documents WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0""")
def json_files_by_name(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = read_json_records(spark, _json_files(spark, sf), "doc_id long, lang string", name_glob="*_ann_*")
    return good.groupBy("doc_id", "lang").agg(F.count("*").cast("int").alias("copies"))


@query("json_files_failed", """
SELECT doc_id % 3 AS folder, doc_id, '[{"doc_id": ' AS text FROM documents WHERE doc_id % 5 = 0""")
def json_files_failed(spark: SparkSession, sf: str) -> DataFrame:
    _, failed = read_json_records(spark, _json_files(spark, sf), "doc_id long, lang string", name_glob="*.json")
    place = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    return failed.select(place(r"/d(\d)/").alias("folder"), place(r"_(\d+)\.json").alias("doc_id"), "text")


SPLIT = 70


@query("split_files", "SELECT o_orderkey, o_orderstatus, TRUE AS small FROM orders")
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "split")
    write_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, SPLIT)
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"))
    # Files are many, so they are read once: a file's rows are counted where they meet.
    return back.withColumn("small", F.count("*").over(Window.partitionBy("file")) <= SPLIT).drop("file")


@query("written_failures", """
SELECT 'read' AS step, 'not JSON, or not of the schema' AS error, '{"doc_id":' || doc_id || '}' AS record FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'checked', 'short', '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' FROM documents WHERE n_chars < 500""")
def written_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps' failures; the first runs twice."""
    path, docs = scratch(spark, "failures"), table(spark, sf, "documents")
    lines = scratch(spark, "lines")
    bad = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("{"), F.col("doc_id"))).otherwise(F.to_json(F.struct("doc_id")))
    docs.select(bad.alias("value")).write.text(lines)
    for _ in range(2):
        failed = read_ndjson(spark, lines, "doc_id long")[1]
        write_failures(failed.select(F.substring("text", 2, 20).cast("long").alias("doc_id"), "error"), path, "read")
    write_failures(docs.filter("n_chars < 500").select("doc_id", "lang", F.lit("short").alias("error")), path, "checked")
    return spark.read.schema("step string, error string, record string").json(path).select("step", "error", "record")


@query("record_counts", "SELECT count(*) AS record_count, count(*) FILTER (n_chars < 500) AS error_count FROM documents")
def record_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted, seen = with_metrics(table(spark, sf, "documents"), "documents", F.col("n_chars") < 500)
    counted.write.parquet(scratch(spark, "counted"))
    return spark.createDataFrame([(seen.get["record_count"], seen.get["error_count"])], "record_count long, error_count long")


@query("parts_without_id", f"""WITH {PARTS_SQL}
SELECT CASE WHEN doc_id % 2 = 0 THEN '' END AS id, 'missing document id' AS error FROM fate
CROSS JOIN LATERAL (SELECT unnest(range(n + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 17 = 0 AND n >= 3 THEN 1 ELSE 0 END))) WHERE doc_id % 6 < 2""")
def parts_without_id(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("id") % 6 == 0, "").when(F.col("id") % 6 != 1, F.col("id").cast("string"))
    failed = assemble_blobs(parts(spark, sf).withColumn("id", key))[1]
    return failed.filter("coalesce(id, '') = ''")


@query("assembled_sequences", f"""WITH {PARTS_SQL}
SELECT doc_id AS id, array_to_string(range(1, n + 1), ',') AS blob_sequence FROM fate WHERE error IS NULL AND NOT unnumbered""")
def assembled_sequences(spark: SparkSession, sf: str) -> DataFrame:
    good = assemble_blobs(parts(spark, sf))[0].filter("id % 37 <> 0")
    return good.select("id", F.array_join(F.col("blob_sequence").cast("array<string>"), ",").alias("blob_sequence"))


@query("decompressed_payloads", """
WITH unpacked AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN text WHEN 4 THEN chr(10) || 'ocf_blob' || chr(0) || '{\\rtf1 ' || text || '}'
    ELSE '%PDF-1.7 ' || text || '%%EOF' END AS raw
  FROM documents WHERE doc_id % 6 >= 3 AND doc_id % 17 <> 0 AND doc_id % 12 <> 11)
SELECT doc_id, octet_length(encode(raw)) AS decompressed_len, lower(hex(encode(raw)[1:16])) AS decompressed_head_hex FROM unpacked""")
def decompressed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = resolve_payload(payloads(spark, sf))
    return good.filter("is_lzw_compressed").select("doc_id", F.col("decompressed_len").cast("long").alias("decompressed_len"), "decompressed_head_hex")


_BACKUP = f"""WITH {PATIENTS_SQL},
dated AS (SELECT patient, ordinal, bad, CASE WHEN {{when}} THEN dod ELSE DATE '2001-02-03' END AS dod FROM raw),
last AS (SELECT patient, arg_max(dod, ordinal) FILTER (NOT bad) AS dod, arg_max(ordinal, ordinal) FILTER (NOT bad) AS had FROM dated GROUP BY patient)
SELECT patient, coalesce(CAST(strftime(dod, '%Y%m%d%H%M%S') AS BIGINT), 0) AS dod FROM last WHERE had IS NOT NULL"""


def _with_backup(spark: SparkSession, sf: str) -> DataFrame:
    return patients(spark, sf).withColumn("notified", F.lit("2001-02-03"))


@query("patient_death_backup", _BACKUP.format(when="FALSE"))
def death_backup(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a date of death, but with a column that stands in for it."""
    cols = PatientColumns(death_backup="notified")
    rows = patient_table(_with_backup(spark, sf).drop("deathdate"), _as_of(), cols)
    return rows.filter("has_dates").select("patient", "dod")


@query("patient_death_filled", _BACKUP.format(when="dod IS NOT NULL"))
def death_filled(spark: SparkSession, sf: str) -> DataFrame:
    records = _with_backup(spark, sf).withColumn("notified", F.lit("2001-02-03").cast("timestamp_ntz"))
    rows = patient_table(records, _as_of(), PatientColumns(death_backup="notified"), death_when="null")
    return rows.filter("has_dates").select("patient", "dod")


@query("records_without_patient", "SELECT c_custkey + 7 AS docid, 'record without a patient' AS error FROM customer WHERE c_custkey % 9 = 0")
def records_without_patient(spark: SparkSession, sf: str) -> DataFrame:
    records = patients(spark, sf).withColumn("patient", F.when(F.col("ordinal") % 9 != 0, F.col("patient")))
    return nameless_patients(records).select("docid", "error")


@query("nlp_request_bodies", "SELECT coalesce(text, '') AS text, conv_id, turn, role, TRUE AS fits FROM conversations")
def nlp_request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The bodies that are sent, taken apart into the records they hold, whole."""
    sent = request_batches(to_nlp_request(table(spark, sf, "conversations"), "text"), batch_size=100)
    record = "struct<text:string,footer:struct<conv_id:long,turn:long,role:string>>"
    one = F.array(F.from_json("request", f"content {record}")["content"])
    many = F.from_json("request", f"content array<{record}>")["content"]
    listed = F.when(F.get_json_object("request", "$.content").startswith("["), many).otherwise(one)
    rows = sent.select(F.explode(listed).alias("r"), (F.size(listed) == F.col("n_records")).alias("whole"), (F.col("n_records") <= 100).alias("small"))
    return rows.select("r.text", "r.footer.conv_id", "r.footer.turn", "r.footer.role", (F.col("whole") & F.col("small")).alias("fits"))
