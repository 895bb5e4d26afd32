"""Queries on records whose keys aren't known: responses with uneven footers, ids in JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import (
    deid_records,
    has_field,
    ids_csv,
    json_records,
    nlp_records,
    ocr_records,
    open_fields,
    parse_deid,
    read_open_records,
)
from workload import query
from workload.inputs import table
from workload.scratch import scratch


def _lines(df: DataFrame, name: str, *parts: Column) -> str:
    """Each row as one line of JSON, put together from texts; the folder it is in."""
    path = scratch(df.sparkSession, name)
    df.select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value")).write.text(path)
    return path


def _text(col: Column) -> Column:
    """A string as JSON."""
    return F.to_json(F.to_variant_object(F.struct(col.alias("t")))).substr(F.lit(6), F.length(F.to_json(F.to_variant_object(F.struct(col.alias("t"))))) - 6)


def _uneven(spark: SparkSession, sf: str) -> str:
    """Documents as responses; a third of the footers have a ``timestamp``, a third have it as null, and one in
    five a key of its own that no other has."""
    doc = F.col("doc_id")
    stamp = F.when(doc % 3 == 0, F.lit("")).when(doc % 3 == 1, F.lit(',"timestamp":null')).otherwise(F.concat(F.lit(',"timestamp":'), _text(F.col("source"))))
    own = F.when(doc % 5 == 0, F.concat(F.lit(',"key '), doc.cast("string"), F.lit('":'), doc.cast("string"))).otherwise("")
    marks = F.when(doc % 4 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"0":{"id":0,"lang":"mark"},"1":{"id":1}}]')))
    done = F.when(doc % 7 == 0, F.lit("false")).otherwise("true")
    return _lines(
        table(spark, sf, "documents"), "uneven",
        '{"model_info":{"name":"lexicon"},"result":{"text":', _text(F.concat(F.lit("clean "), F.col("lang"))), ',"success":', done,
        ',"timestamp":"2024","annotations":', marks, ',"footer":{"docid":', doc.cast("string"), stamp, own, "}}}",
    )


_STAMP = "CASE doc_id % 3 WHEN 0 THEN '2024' WHEN 1 THEN NULL ELSE source END"
_OWN = "CASE WHEN doc_id % 5 = 0 THEN doc_id END"


def _own_key(record: Column) -> Column:
    """The value of a record's own key, by its number."""
    entries = F.map_entries(F.try_variant_get(record, "$", "map<string,variant>"))
    return F.try_variant_get(F.get(F.filter(entries, lambda e: e["key"].startswith("key ")), F.lit(0))["value"], "$", "long")


@query("open_ocr_records", f"""
SELECT doc_id AS docid, 'clean ' || lang AS body, doc_id % 7 <> 0 AS success, {_STAMP} AS timestamp, TRUE AS has_timestamp, {_OWN} AS own
FROM documents""")
def open_ocr(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = ocr_records(read_open_records(spark, _uneven(spark, sf))[0], text_col="body")
    record = F.col("record")
    fields = {"docid": "long", "body": "string", "success": "boolean", "timestamp": "string"}
    return good.select(
        *[F.try_variant_get(record, f"$.{n}", k).alias(n) for n, k in fields.items()],
        has_field(record, "timestamp").alias("has_timestamp"), _own_key(record).alias("own"),
    )


@query("open_nlp_records", f"""
SELECT doc_id AS docid, unnest([0, 1]) AS id, unnest(['mark', NULL]) AS lang, {_STAMP} AS timestamp, doc_id || '_' || unnest([0, 1]) AS annotation_id
FROM documents WHERE doc_id % 4 <> 0""")
def open_nlp(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = nlp_records(read_open_records(spark, _uneven(spark, sf))[0], id_col="docid")
    return open_fields(good, {"docid": "long", "id": "int", "lang": "string", "timestamp": "string", "annotation_id": "string"})


@query("open_deid_records", f"""
SELECT doc_id AS docid, CASE WHEN doc_id % 4 <> 0 THEN 'clean ' || lang END AS clean, CASE WHEN doc_id % 4 = 0 THEN 'clean ' || lang END AS text,
  CASE WHEN doc_id % 4 = 0 THEN 'no_annotations' END AS service_status,
  CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 2 THEN NULL ELSE {_STAMP} END AS timestamp, {_OWN} AS own
FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 7 <> 0""")
def open_deid(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = deid_records(read_open_records(spark, _uneven(spark, sf))[0], text_col="clean")
    names = ("docid", "clean", "text", "service_status", "timestamp")
    return good.select(
        *[F.try_variant_get("record", f"$.{n}", "long" if n == "docid" else "string").alias(n) for n in names], _own_key(F.col("record")).alias("own")
    )


@query("uneven_footers", """
SELECT doc_id AS docid, CASE WHEN doc_id % 3 = 2 THEN source ELSE '2024' END AS timestamp, 'clean ' || lang AS text
FROM documents WHERE doc_id % 4 <> 0""")
def uneven_footers(spark: SparkSession, sf: str) -> DataFrame:
    shape = "result struct<text: string, success: boolean, timestamp: string, annotations: array<map<string, struct<id: int, lang: string>>>, "
    shape += "footer: struct<docid: long, timestamp: string, text: string>>"
    answers = spark.read.schema(shape).json(_uneven(spark, sf))
    return parse_deid(answers, info_col=None, no_annotations="drop").select("docid", "timestamp", "text")


IDS = 50


@query("ids_from_json", f"""
WITH ids AS (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth
  FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 3 <> 2)
SELECT source, CAST(nth // {IDS} AS BIGINT) AS slice, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids_csv, count(*) AS ids_count,
  length(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS ids_len
FROM ids GROUP BY ALL""")
def ids_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """One list a row, bare or under ``records``, with an odd element beside the id; some are no JSON."""
    doc = F.col("doc_id")
    number = doc.cast("string")
    value = F.when(doc % 3 == 0, number).when(doc % 3 == 1, F.concat(F.lit('"  '), number, F.lit('"'))).otherwise(F.concat(number, F.lit(".0")))
    elements = F.concat(F.lit('[7, "{}", {"id": null}, {"x": [1]}, {"id": '), value, F.lit("}]"))
    whole = F.when(doc % 13 == 0, F.concat(elements, F.lit("]["))).when(doc % 2 == 0, elements).otherwise(F.concat(F.lit('{"records": '), elements, F.lit("}")))
    broken = F.when(doc % 13 == 0, F.lit('[{"id": 1')).otherwise(whole)
    rows = json_records(table(spark, sf, "documents").select("source", "doc_id", broken.alias("j")), "j", "id", ["source", "doc_id"])
    return ids_csv(rows, "id", ["doc_id", "position"], ["source"], max_ids=IDS)
