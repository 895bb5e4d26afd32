"""The test tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_annotations(table(spark, sf_dir, "events"))


def shape_annotations(events: DataFrame) -> DataFrame:
    """Events as concept mentions; four events make up a document.

    Meta annotations come from the number ``k`` in the event's properties.
    """
    k = F.substring_index(F.substring_index("props", ": ", -1), "}", 1).cast("int")

    def value(text: F.Column) -> F.Column:
        return F.struct(text.alias("value"), F.lit(1.0).alias("confidence"))

    time = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "Past").when(k % 5 == 2, "Future").otherwise("Recent")
    meta = F.struct(
        value(F.when(k % 10 == 0, "Family").otherwise("Patient")).alias("Subject"),
        value(F.when(k % 7 == 0, "False").otherwise("True")).alias("Presence"),
        F.when(k % 11 != 0, value(time)).alias("Time"),
    )
    return events.select(
        F.expr("event_id div 4").alias("docid"),
        F.col("event_id").alias("ann_id"),
        F.col("event_type").alias("cui"),
        F.col("value").alias("score"),
        meta.alias("meta_anns"),
        F.col("ts").alias("timestamp"),
    )


def doc2ptt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the document to patient table."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("docid"), F.col("o_custkey").alias("patient"))


# The same shapes for the SQL twins.
ANNOTATIONS_SQL = """
mentions AS (
  SELECT event_id // 4 AS docid, event_id AS ann_id, event_type AS cui, value AS score, ts,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k
  FROM events),
checked AS (
  SELECT *, k % 10 <> 0 AS is_patient, k % 7 <> 0 AS is_present, k % 11 <> 0 AS has_time, k % 5 = 2 AS future
  FROM mentions),
affirmed AS (
  SELECT * FROM checked WHERE is_patient AND is_present AND has_time AND NOT future),
facts AS (
  SELECT a.cui, o.o_custkey AS patient, count(*) AS n,
         min(CAST(round_even(epoch_us(a.ts) / 1e6, 0) AS BIGINT)) AS first_seen
  FROM affirmed a JOIN orders o ON o.o_orderkey = a.docid
  GROUP BY a.cui, o.o_custkey)
"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as patient records; four records or so to a patient."""
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1920-01-01").cast("date"), (key % 30000).cast("int"))
    died = F.date_add(F.lit("1990-01-01").cast("date"), (key % 9000).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit(' "'), F.expr("c_custkey div 4").cast("string"), F.lit("'\t")).alias("patient"),
        F.concat(F.col("c_mktsegment"), F.when(key % 2 == 0, "-GROUP").otherwise("_group")).alias("ethnicity"),
        F.when(key % 5 == 0, "M").when(key % 5 == 1, "2").when(key % 5 == 2, "Male").when(key % 5 == 3, "FEMALE").alias("gender"),
        F.when(key % 11 == 0, "1920-13-77").when(key % 13 == 0, "null").otherwise(F.date_format(born, "yyyy-MM-dd")).alias("birthdate"),
        F.when(key % 3 == 0, died.cast("timestamp_ntz")).alias("deathdate"),
        (key + 7).alias("docid"),
        key.alias("ordinal"),
    )


PATIENTS_SQL = """
raw AS (
  SELECT CAST(c_custkey // 4 AS VARCHAR) AS patient,
         lower(c_mktsegment) || ' group' AS ethnicity,
         CASE c_custkey % 5 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' WHEN 3 THEN 'Female' ELSE 'Unknown' END AS sex,
         c_custkey % 11 = 0 AS bad,
         CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 13 <> 0
              THEN DATE '1920-01-01' + CAST(c_custkey % 30000 AS INT) END AS dob,
         CASE WHEN c_custkey % 3 = 0 THEN DATE '1990-01-01' + CAST(c_custkey % 9000 AS INT) END AS dod,
         CAST(c_custkey + 7 AS VARCHAR) AS docid, c_custkey AS ordinal
  FROM customer)
"""


def wrapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search hits: most inside a wrapper, the text of some blank."""
    docs = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    text = F.when(doc % 13 == 0, F.lit("")).when(doc % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    body = F.struct(F.col("lang"), F.col("source"), text.alias("text"))
    return docs.select(
        doc.cast("string").alias("_id"),
        F.when(doc % 3 == 0, body).alias("fields"),
        F.when(doc % 3 == 1, body).alias("_source"),
        F.when(doc % 3 == 2, F.col("lang")).alias("lang"),
        F.when(doc % 3 == 2, F.col("source")).alias("source"),
        F.when(doc % 3 == 2, text).alias("text"),
    )


BLANKED = "CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 29 = 0 THEN NULL ELSE text END"

MODEL = ("lexicon", "1.2.0")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as language-service responses.

    Annotations are the capitalised words of the text, keyed by their position.
    Some documents failed, some have blank text, some have no annotations at all.
    """
    docs = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    entries = F.transform(
        words,
        lambda w, i: F.struct(
            i.cast("string").alias("key"),
            F.struct(
                i.cast("bigint").alias("id"),
                w.alias("source_value"),
                F.array(F.when(F.length(w) > 5, "long").otherwise("short"), F.substring(w, 1, 1)).alias("types"),
                F.length(w).alias("lang"),
            ).alias("value"),
        ),
    )
    none = (doc % 9 == 0)
    result = F.struct(
        F.when(doc % 7 == 0, F.lit("  \n")).when(doc % 31 != 0, F.col("text")).alias("text"),
        (doc % 5 != 0).alias("success"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        F.when(none, F.array()).otherwise(F.array(F.map_from_entries(entries))).alias("annotations"),
        F.struct(doc.alias("docid"), F.col("source"), F.col("lang")).alias("footer"),
    )
    info = F.struct(F.lit(MODEL[0]).alias("service_model"), F.lit(MODEL[1]).alias("service_version"))
    return docs.select(info.alias("model_info"), F.array(result).alias("result"))


RESPONSES_SQL = """
words AS (
  SELECT doc_id, lang, source, generate_subscripts(found, 1) - 1 AS pos, unnest(found) AS word
  FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[A-Z][a-z]+') AS found
        FROM documents WHERE doc_id % 9 <> 0))
"""

PART_CHARS = 200


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_parts(table(spark, sf_dir, "documents")).drop("n_parts")


def shape_parts(docs: DataFrame) -> DataFrame:
    """Document texts cut in base64 parts, with every kind of damage on some."""
    doc, n = F.col("doc_id"), F.col("n")
    slices = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART_CHARS}}}"), F.lit(0))
    cut = docs.select("doc_id", "lang", slices.alias("slices")).withColumn("n", F.size("slices"))
    rows = cut.select("doc_id", "lang", "n", F.posexplode("slices").alias("i", "slice"))
    encoded = F.replace(F.base64(F.encode("slice", "UTF-8")), F.lit("\r\n"), F.lit(""))
    payload = F.when((doc % 23 == 0) & (F.col("i") == 0), F.lit("*not base64*")).when(
        (doc % 41 == 0) & (F.col("i") == n - 1), F.lit(None).cast("string")).otherwise(encoded)
    # Damage: a second part is lost (gap), a first part comes twice, numbers are mixed.
    keep = ~((doc % 17 == 0) & (F.col("i") == 1) & (n >= 3))
    copies = F.when((doc % 19 == 0) & (F.col("i") == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    seq = F.when(doc % 37 == 0, F.lit(None).cast("int")).when((doc % 43 == 0) & (F.col("i") == 1), F.lit(None).cast("int")).otherwise(
        F.col("i") + 1)
    return rows.filter(keep).select(
        doc.alias("id"),
        seq.alias("blob_sequence_num"),
        payload.alias("plain"),
        F.col("lang"),
        F.col("i"),
        n.alias("n_parts"),
        F.explode(copies).alias("copy"),
    ).select(
        "id",
        "blob_sequence_num",
        # The second copy of a part holds other bytes.
        F.when(F.col("copy") == 1, F.lit("ISE=")).otherwise(F.col("plain")).alias("binarydoc"),
        "lang",
        (F.col("id") * 1000000 + F.col("i") * 2 + F.col("copy")).alias("ordinal"),
        "n_parts",
    )


# What becomes of each document of ``parts``, in the order the checks are made.
PARTS_SQL = """
cut AS (
  SELECT doc_id, lang, text, greatest(1, CAST(ceil(length(text) / 200.0) AS INT)) AS n FROM documents),
fate AS (
  SELECT *,
    doc_id % 37 = 0 AS unnumbered,
    CASE WHEN doc_id % 43 = 0 AND doc_id % 37 <> 0 AND n >= 2 AND NOT (doc_id % 17 = 0 AND n >= 3)
           THEN 'sequence number on some parts only'
         WHEN doc_id % 41 = 0 AND NOT (doc_id % 23 = 0 AND n = 1) THEN 'missing payload in a part'
         WHEN doc_id % 37 <> 0 AND doc_id % 19 = 0 THEN 'duplicate sequence number'
         WHEN doc_id % 37 <> 0 AND doc_id % 17 = 0 AND n >= 3 THEN 'sequence gap'
         WHEN doc_id % 23 = 0 THEN 'invalid base64 in a part' END AS error
  FROM cut)
"""
