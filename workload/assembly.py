"""Multi-part document queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions import base64_text, strip_markers
from chartloom.operators import assemble_blobs, encode_payload, resolve_payload
from chartloom.operators.lzw import WIDER_AFTER
from chartloom.plans import Flow, NlpRequests, SchemaMap, TextScrub
from workload import query
from workload.casting import scrub_sql
from workload.inputs import PARTS_SQL, parts, table

_SHAPE = """
SELECT doc_id AS id, lang, md5(payload) AS digest, octet_length(encode(payload)) AS compressed_len,
  lower(hex(encode(payload)[1:16])) AS compressed_head_hex, CAST(blob_parts AS BIGINT) AS blob_parts,
  CAST(low AS BIGINT) AS blob_seq_min, CAST(low + blob_parts - 1 AS BIGINT) AS blob_seq_max
FROM (SELECT *,
  CASE WHEN unnumbered THEN n + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 17 = 0 AND n >= 3 THEN 1 ELSE 0 END
       ELSE n END AS blob_parts,
  CASE WHEN unnumbered THEN 0 ELSE 1 END AS low,
  {payload} AS payload FROM fate WHERE {good})
"""

_PLAIN = """CASE WHEN unnumbered THEN substr(text, 1, 200) || CASE WHEN doc_id % 19 = 0 THEN '!!' ELSE '' END ||
  CASE WHEN doc_id % 17 = 0 AND n >= 3 THEN substr(text, 401) ELSE substr(text, 201) END ELSE text END"""


def _shaped(good: DataFrame) -> DataFrame:
    return good.select(
        "id", "lang", F.md5("binarydoc").alias("digest"), F.col("compressed_len").cast("bigint").alias("compressed_len"),
        "compressed_head_hex", "blob_parts", "blob_seq_min", "blob_seq_max",
    )


@query("assembled_documents", f"WITH {PARTS_SQL} " + _SHAPE.format(payload=_PLAIN, good="error IS NULL"))
def assembled(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(assemble_blobs(parts(spark, sf))[0])


@query("assembly_failures", f"WITH {PARTS_SQL} SELECT doc_id AS id, error FROM fate WHERE error IS NOT NULL")
def failures(spark: SparkSession, sf: str) -> DataFrame:
    return assemble_blobs(parts(spark, sf))[1]


# Duplicates are no failure here, so what they hid comes to light.
_LENIENT = PARTS_SQL.replace("WHEN doc_id % 37 <> 0 AND doc_id % 19 = 0 THEN 'duplicate sequence number'", "")
_LAST = """CASE WHEN NOT unnumbered AND doc_id % 19 = 0 THEN '!!' || substr(text, 201) ELSE """ + _PLAIN + " END"
# With keep_last the second copy of the first part replaces the broken one.
_LENIENT_LAST = _LENIENT.replace(
    "WHEN doc_id % 23 = 0 THEN", "WHEN doc_id % 23 = 0 AND (doc_id % 19 <> 0 OR unnumbered_) THEN"
).replace("unnumbered_", "doc_id % 37 = 0")


@query("assembled_keep_first", f"WITH {_LENIENT} " + _SHAPE.format(payload=_PLAIN, good="error IS NULL"))
def assembled_first(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(assemble_blobs(parts(spark, sf), dup="keep_first")[0])


@query("assembled_keep_last", f"WITH {_LENIENT_LAST} " + _SHAPE.format(payload=_LAST, good="error IS NULL"))
def assembled_last(spark: SparkSession, sf: str) -> DataFrame:
    return _shaped(assemble_blobs(parts(spark, sf), dup="keep_last")[0])


def lzw_encode(data: bytes) -> bytes:
    """The encoder that goes with the decoder, for test input only."""
    entries: dict[int, int] = {}  # prefix code and next byte -> code
    out, bits, held, width, codes = bytearray(), 0, 0, 9, 0

    def put(code: int) -> None:
        nonlocal bits, held, width, codes
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
        codes += 1
        if codes in WIDER_AFTER:
            width += 1

    prefix = -1
    for byte in data:
        longer = (prefix << 8) | byte
        if prefix < 0:
            prefix = byte
        elif longer in entries:
            prefix = entries[longer]
        else:
            put(prefix)
            if len(entries) < 8192 - 258:
                entries[longer] = 258 + len(entries)
            prefix = byte
    if prefix >= 0:
        put(prefix)
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 0xFF)
    return bytes(out)


@F.pandas_udf(T.BinaryType())
def _lzw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda b: None if b is None else lzw_encode(bytes(b)))


_packed_once = _lzw.asNondeterministic()


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as stored payloads: inside a PDF, an RTF, compressed, or damaged."""
    doc, text = F.col("doc_id"), F.encode("text", "UTF-8")

    def b(value: str) -> F.Column:
        return F.lit(value).cast("binary")

    inner = (
        F.when(doc % 6 == 0, F.concat(b("ocf_blob\0%PDF-1.7 "), text, b(" %%EOF tail")))
        .when(doc % 6 == 1, F.concat(b("lead {\\rtf1 "), text, b("} tail")))
        .when(doc % 6 == 2, F.concat(b("%PDF-1.4 no end {\\rtf1 "), text, b("}")))
    )
    packed = (
        F.when(doc % 6 == 3, text)
        .when(doc % 6 == 4, F.concat(b("\nocf_blob\0{\\rtf1 "), text, b("}")))
        .when(doc % 6 == 5, F.concat(b("%PDF-1.7 "), text, F.when(doc % 12 == 5, b("%%EOF")).otherwise(b(""))))
    )
    stored = F.coalesce(inner, F.when(doc % 17 == 0, b("\x01\x02")).otherwise(F.col("packed")))
    docs = table(spark, sf, "documents").withColumn("packed", _packed_once(packed))
    return docs.select("doc_id", stored.alias("binarydoc"))


_RESOLVED = """
kinds AS (
  SELECT doc_id, doc_id % 6 AS kind,
    CASE doc_id % 6
      WHEN 0 THEN '%PDF-1.7 ' || text || ' %%EOF'
      WHEN 1 THEN '{\\rtf1 ' || text || '}'
      WHEN 2 THEN '{\\rtf1 ' || text || '}'
      WHEN 3 THEN text
      WHEN 4 THEN '{\\rtf1 ' || text || '}'
      ELSE '%PDF-1.7 ' || text || '%%EOF' END AS payload,
    CASE WHEN doc_id % 6 >= 3 AND doc_id % 17 = 0 THEN 'undecodable'
         WHEN doc_id % 12 = 11 THEN 'open' END AS failure
  FROM documents)
"""


@query("resolved_payloads", f"""WITH {_RESOLVED}
SELECT doc_id, md5(payload) AS digest,
  CASE kind WHEN 0 THEN 'embedded_pdf' WHEN 1 THEN 'embedded_rtf' WHEN 2 THEN 'embedded_rtf' WHEN 3 THEN 'cerner_lzw'
    WHEN 4 THEN 'cerner_lzw_rtf' ELSE 'cerner_lzw_pdf' END AS blob_payload_source,
  kind >= 3 AS is_lzw_compressed FROM kinds WHERE failure IS NULL""")
def resolved(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = resolve_payload(payloads(spark, sf))
    return good.select("doc_id", F.md5("binarydoc").alias("digest"), "blob_payload_source", "is_lzw_compressed")


@query("unresolved_payloads", f"""WITH {_RESOLVED}
SELECT doc_id, CASE failure WHEN 'open' THEN 'decoded pdf stream has no end marker'
  ELSE 'payload is no embedded stream and not LZW: stream ends before its end code' END AS error
FROM kinds WHERE failure IS NOT NULL""")
def unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_payload(payloads(spark, sf))[1].select("doc_id", "error")


@query("stripped_markers", "SELECT doc_id, md5(text) AS digest, to_base64(encode(text)) AS encoded, text AS raw FROM documents")
def stripped(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.concat(F.lit("\nocf_blob\0").cast("binary"), F.encode("text", "UTF-8"), F.lit("ocr_blob\0").cast("binary"))
    rows = table(spark, sf, "documents").select("doc_id", strip_markers(wrapped).alias("binarydoc"))
    raw = encode_payload(rows.withColumn("kept", F.col("binarydoc")), mode="raw")
    return raw.select("doc_id", F.md5("kept").alias("digest"), base64_text(F.col("kept")).alias("encoded"), F.col("binarydoc").alias("raw"))


@query("document_flow", f"""WITH {PARTS_SQL}, whole AS (SELECT doc_id, lang, {_PLAIN} AS text FROM fate WHERE error IS NULL)
SELECT CAST(doc_id AS VARCHAR) AS id, {scrub_sql("text")} AS text, upper(lang) AS dept FROM whole
WHERE length({scrub_sql("text")}) >= 50""")
def document_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Parts to documents to scrubbed requests, as a chain of steps."""
    whole, _ = assemble_blobs(parts(spark, sf))
    notes = whole.select("id", F.col("binarydoc").cast("string").alias("body"), F.upper("lang").alias("lang"))
    mapping = {"_id": "id", "text": "body", "dept": ["lang"]}
    flow = Flow([SchemaMap(mapping=mapping, preserve_unmapped=False), TextScrub(), NlpRequests(min_chars=50)])
    return flow.run(notes).good.select(F.col("id").cast("string").alias("id"), "text", "footer.dept")


@query("document_flow_failures", f"""WITH {PARTS_SQL}, whole AS (SELECT doc_id, lang, {_PLAIN} AS text FROM fate WHERE error IS NULL)
SELECT 'NlpRequests' AS step, 'text shorter than 50 characters' AS error, CAST(doc_id AS VARCHAR) AS id FROM whole
WHERE length({scrub_sql("text")}) < 50""")
def document_flow_failures(spark: SparkSession, sf: str) -> DataFrame:
    whole, _ = assemble_blobs(parts(spark, sf))
    notes = whole.select(F.col("id").alias("_id"), F.col("binarydoc").cast("string").alias("text"))
    failures_ = Flow([TextScrub(), NlpRequests(min_chars=50)]).run(notes).failures
    return failures_.select("step", "error", F.get_json_object("record", "$._id").alias("id"))
