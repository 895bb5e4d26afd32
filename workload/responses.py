"""Service response queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import flatten_annotations, merge_ocr, parse_deid, parse_nlp, parse_ocr
from workload import query
from workload.inputs import MODEL, RESPONSES_SQL, responses, table


def _ocr(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as text-extraction responses; some have no text, some no verdict."""
    doc = F.col("doc_id")
    result = F.struct(
        F.when(doc % 8 != 0, F.create_map(F.lit("chars"), F.col("n_chars").cast("string"))).alias("metadata"),
        F.when(doc % 13 != 0, F.col("text")).alias("text"),
        F.when(doc % 7 != 0, doc % 2 == 0).alias("success"),
        F.concat(F.lit("2024-01-"), F.lpad((doc % 28 + 1).cast("string"), 2, "0")).alias("timestamp"),
        F.struct(doc.alias("_id"), F.col("lang"), F.upper("source").alias("timestamp")).alias("footer"),
    )
    return table(spark, sf, "documents").select(result.alias("result"))


@query("parse_ocr", """
SELECT CASE WHEN doc_id % 8 <> 0 THEN CAST(n_chars AS VARCHAR) END AS chars,
  CASE WHEN doc_id % 13 <> 0 THEN text ELSE '' END AS body,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 = 0 ELSE FALSE END AS success,
  upper(source) AS timestamp, doc_id AS _id, lang FROM documents""")
def ocr_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse_ocr(_ocr(spark, sf), text_col="body")
    return rows.select(F.col("metadata")["chars"].alias("chars"), "body", "success", "timestamp", "_id", "lang")


@query("merge_ocr", """
SELECT page_id, url, d.text AS text, CAST(d.n_chars AS VARCHAR) AS chars,
  '2024-01-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') AS ocr_timestamp
FROM pages p JOIN (SELECT doc_id, n_chars, CASE WHEN doc_id % 13 <> 0 THEN text END AS text FROM documents) d ON d.doc_id = p.page_id
WHERE d.doc_id % 8 <> 0
UNION ALL
SELECT page_id, url, CASE WHEN doc_id % 13 <> 0 THEN text END, NULL, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')
FROM pages JOIN documents ON doc_id = page_id WHERE doc_id % 8 = 0""")
def merged_ocr(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "pages").select("page_id", "url", F.lit("stale").alias("text"))
    rows = merge_ocr(source, _ocr(spark, sf), "page_id", ocr_key=F.col("result.footer._id"))
    return rows.select("page_id", "url", "text", F.col("ocr_metadata")["chars"].alias("chars"), "ocr_timestamp")


@query("parse_nlp", f"""WITH {RESPONSES_SQL}
SELECT '{MODEL[0]}' AS model, '2024-01-01T00:00:00' AS timestamp, pos AS id, word AS source_value,
  CASE WHEN length(word) > 5 THEN 'long' ELSE 'short' END AS length_type,
  lang, doc_id AS docid, source, doc_id || '_' || pos AS annotation_id FROM words""")
def nlp_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse_nlp(responses(spark, sf), id_col="docid")
    return rows.select(
        F.col("service_model.service_model").alias("model"), "timestamp", "id", "source_value",
        F.col("types")[0].alias("length_type"), "lang", "docid", "source", "annotation_id",
    )


@query("flatten_annotations", f"""WITH {RESPONSES_SQL}
SELECT pos AS nlp_id, word AS nlp_source_value, length(word) AS nlp_lang, '{MODEL[0]}' AS service_model,
  '{MODEL[1]}' AS service_version, '2024-01-01T00:00:00' AS timestamp, doc_id AS meta_docid, source AS meta_source,
  doc_id || '_' || pos AS document_annotation_id
FROM words WHERE length(word) <= 5 AND word[1] <> 'E'""")
def keyed_annotations(spark: SparkSession, sf: str) -> DataFrame:
    result = F.transform(
        "result", lambda r: r.withField("annotations", F.coalesce(F.get(r["annotations"], F.lit(0)), F.map_from_entries(
            F.filter(F.map_entries(F.get(F.col("result")[0]["annotations"], F.lit(0))), lambda e: F.lit(False))))))
    df = responses(spark, sf).withColumn("result", result)
    rows = flatten_annotations(df, "keyed", "docid", include_footer=["source", "absent"], ignore_types=["long", "E"])
    return rows.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in rows.columns if c != "nlp.types"])


@query("flatten_listed_annotations", """
WITH turns AS (
  SELECT conv_id, turn, role, generate_subscripts(found, 1) - 1 AS pos, unnest(found) AS word
  FROM (SELECT conv_id, turn, role, regexp_extract_all(text, '[A-Z][a-z]+') AS found FROM conversations))
SELECT word AS nlp_source_value, 'tagger' AS service_model, '0.9' AS service_version,
  CAST(turn AS VARCHAR) AS timestamp, conv_id || '-' || turn AS meta__id,
  conv_id || '-' || turn || '_' || pos AS document_annotation_id
FROM turns WHERE role <> 'system'""")
def listed_annotations(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    output = F.struct(
        F.struct(
            F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").cast("string").alias("nlp_processing_date")
        ).alias("record_metadata"),
        F.transform(words, lambda w: F.struct(w.alias("source_value"), F.array(F.col("role")).alias("types"))).alias("annotations"),
    )
    info = F.struct(F.lit("tagger").alias("service_model"), F.lit("0.9").alias("service_version"))
    df = table(spark, sf, "conversations").select(info.alias("model_info"), output.alias("result"))
    rows = flatten_annotations(df, "listed", ignore_types=["system"])
    return rows.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in rows.columns if c != "nlp.types"])


# What becomes of a response, in the order the checks are made.
_DEID = """
answers AS (
  SELECT doc_id, source, lang, doc_id % 5 <> 0 AS success,
    CASE WHEN doc_id % 7 = 0 THEN '  ' || chr(10) WHEN doc_id % 31 <> 0 THEN text END AS answer,
    CASE WHEN doc_id % 9 = 0 THEN 0 ELSE len(regexp_extract_all(text, '[A-Z][a-z]+')) END AS n
  FROM documents),
judged AS (
  SELECT *, CASE WHEN success AND trim(answer, ' ' || chr(10)) = '' THEN 'blank' WHEN n = 0 AND success THEN 'bare'
                 WHEN n = 0 THEN 'gone' ELSE 'whole' END AS kind
  FROM answers)
"""


@query("parse_deid", f"""WITH {_DEID}
SELECT CASE WHEN kind = 'whole' THEN '2024-01-01T00:00:00' END AS timestamp, coalesce(answer, '') AS text,
  CASE WHEN kind = 'whole' THEN n END AS n_annotations, doc_id AS docid, source, lang,
  CASE WHEN kind = 'bare' THEN 'no_annotations' END AS service_status
FROM judged WHERE kind IN ('whole', 'bare')""")
def deid_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse_deid(responses(spark, sf))
    return rows.select("timestamp", "text", F.size("annotations").alias("n_annotations"), "docid", "source", "lang", "service_status")


@query("parse_deid_restored", f"""WITH {_DEID}
SELECT CASE WHEN kind = 'whole' THEN coalesce(answer, '') END AS clean_text,
  CASE WHEN kind = 'blank' THEN coalesce(answer, '') END AS text,
  CASE WHEN kind = 'whole' THEN 0 END AS n_annotations, doc_id AS docid,
  CASE WHEN kind = 'blank' THEN 'skipped_empty_text' END AS service_status
FROM judged WHERE kind IN ('whole', 'blank')""")
def deid_restored(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse_deid(
        responses(spark, sf), text_col="clean_text", document_text_col="text", keep_annotations=False,
        empty_text="restore", no_annotations="drop",
    )
    return rows.select("clean_text", "text", F.size("annotations").alias("n_annotations"), "docid", "service_status")
