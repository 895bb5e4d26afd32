"""Request and payload queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import (
    binary_to_base64,
    explode_records,
    extract_payload,
    hits_to_request,
    request_batches,
    to_attributes,
    to_ndjson,
    to_nlp_request,
    to_ocr_request,
    unwrap_hit,
)
from workload import query
from workload.inputs import BLANKED, table, wrapped_documents


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.when(F.col("doc_id") % 13 != 0, F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", "lang", payload.alias("binarydoc"))


_ENCODED = "CASE WHEN doc_id % 13 <> 0 THEN to_base64(encode(text)) END"


@query("binary_to_base64", f"SELECT {_ENCODED} AS binarydoc, doc_id, lang FROM documents")
def encode_binary(spark: SparkSession, sf: str) -> DataFrame:
    return binary_to_base64(_binary(spark, sf))


@query("ocr_request", f"""SELECT {_ENCODED} AS binary_data,
  '{{"doc_id":' || doc_id || ',"lang":"' || lang || '"}}' AS footer FROM documents""")
def ocr_request(spark: SparkSession, sf: str) -> DataFrame:
    return to_ocr_request(_binary(spark, sf)).select("binary_data", F.to_json("footer").alias("footer"))


def _noted(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    text = F.when(doc % 13 == 0, F.lit("")).when(doc % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(doc.alias("docid"), text.alias("text"), "source", "n_chars")


@query("nlp_request", f"""SELECT coalesce({BLANKED}, '') AS text, doc_id AS docid, source, n_chars FROM documents""")
def nlp_request(spark: SparkSession, sf: str) -> DataFrame:
    return to_nlp_request(_noted(spark, sf), "text").select("text", "footer.*")


@query("nlp_request_batches", """
SELECT count(*) AS n_records, sum(length(text) + length(CAST(conv_id AS VARCHAR)) + length(CAST(turn AS VARCHAR)) + length(role)) AS n_chars
FROM conversations""")
def nlp_request_batches(spark: SparkSession, sf: str) -> DataFrame:
    requests = to_nlp_request(table(spark, sf, "conversations"), "text")
    record = "struct<text:string,footer:struct<conv_id:string,turn:string,role:string>>"
    sent = request_batches(requests, batch_size=100)
    one = F.from_json("request", f"struct<content:{record}>")["content"]
    many = F.from_json("request", f"struct<content:array<{record}>>")["content"]
    records = sent.select(F.when(F.col("n_records") == 1, F.array(one)).otherwise(many).alias("records"))
    r = explode_records(records, "records")
    chars = F.length("text") + F.length("footer.conv_id") + F.length("footer.turn") + F.length("footer.role")
    return r.agg(F.count("*").alias("n_records"), F.sum(chars).alias("n_chars"))


@query("unwrapped_hits", f"SELECT CAST(doc_id AS VARCHAR) AS _id, lang, source, {BLANKED} AS text FROM documents")
def unwrapped_hits(spark: SparkSession, sf: str) -> DataFrame:
    return unwrap_hit(wrapped_documents(spark, sf))


@query("hit_requests", f"""SELECT id, text, id AS footer_id, lang, source
FROM (SELECT CAST(doc_id AS VARCHAR) AS id, {BLANKED} AS text, lang, source FROM documents) WHERE length(text) > 1""")
def hit_requests(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = hits_to_request(wrapped_documents(spark, sf))
    return ok.select("id", "text", F.col("footer._id").alias("footer_id"), "footer.lang", "footer.source")


@query("hit_requests_invalid", f"""SELECT id FROM (SELECT CAST(doc_id AS VARCHAR) AS id, {BLANKED} AS text FROM documents)
WHERE text IS NULL OR length(text) <= 1""")
def hit_requests_invalid(spark: SparkSession, sf: str) -> DataFrame:
    return hits_to_request(wrapped_documents(spark, sf))[1].select(F.col("_id").alias("id"))


@query("extracted_payload", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(n_chars AS VARCHAR) AS n_chars,
  CASE WHEN doc_id % 13 <> 0 THEN octet_length(encode(text)) END AS n_bytes,
  CASE WHEN doc_id % 13 <> 0 THEN md5(text) END AS digest FROM documents""")
def extracted_payload(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    encoded = F.when(F.col("doc_id") % 13 == 0, "*broken*").otherwise(F.base64(F.encode("text", "UTF-8")))
    rows = extract_payload(docs.select("doc_id", "n_chars", encoded.alias("binarydoc")))
    return rows.select("doc_id", "n_chars", F.octet_length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("digest"))


@query("record_attributes", """SELECT text AS content, CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars,
  'doc_id,text,lang,source,n_chars' AS attribute_list FROM documents""")
def record_attributes(spark: SparkSession, sf: str) -> DataFrame:
    rows = to_attributes(table(spark, sf, "documents"), "text")
    a = F.col("attributes")
    return rows.select(
        "content", a["doc_id"].alias("doc_id"), a["lang"].alias("lang"), a["source"].alias("source"),
        a["n_chars"].alias("n_chars"), F.array_join("attribute_list", ",").alias("attribute_list"),
    )


@query("ndjson_lines", """
SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || coalesce(CAST(custkey AS VARCHAR), 'null') ||
  ',"o_totalprice":"' || CAST(o_totalprice AS DECIMAL(18,2)) || '","o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ||
  '","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","raw":"' || to_base64(encode(o_orderpriority)) ||
  '","stamp":"' || strftime(o_orderdate + INTERVAL 1500 MILLISECOND, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS value
FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS custkey FROM orders)""")
def ndjson_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"),
        "o_orderdate",
        F.to_date("o_orderdate").alias("day"),
        F.encode("o_orderpriority", "UTF-8").alias("raw"),
        F.timestamp_add("MILLISECOND", F.lit(1500), F.col("o_orderdate")).alias("stamp"),
    )
    return to_ndjson(rows)
