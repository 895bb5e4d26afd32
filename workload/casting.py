"""Cast and text queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions import CLINICAL_SCRUB_RULES
from chartloom.operators import cast_common, cast_dates_by_name, match_text, scrub_text, with_keyword
from chartloom.sources import decode_with_fallback
from workload import query
from workload.inputs import table


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the time as text in several notations, and other text columns."""
    event, ts = F.col("event_id"), F.col("ts")
    text = (
        F.when(event % 6 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(event % 6 == 1, F.date_format(ts, "yyyy-MM-dd"))
        .when(event % 6 == 2, F.date_format(ts, "yyyyMMdd"))
        .when(event % 6 == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(event % 6 == 4, F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts).cast("string"))
        .otherwise(F.lit("soon"))
    )
    return table(spark, sf, "events").select(
        event,
        text.alias("Event_DateTime"),
        F.when(event % 5 == 0, "many").otherwise(F.col("user_id").cast("string")).alias("users"),
        F.when(event % 2 == 0, "true").when(event % 3 == 0, "perhaps").otherwise("false").alias("flag"),
        F.col("value").cast("string").alias("amount"),
        F.concat_ws(",", (F.col("event_id") % 90).cast("string"), F.when(event % 7 == 0, "west").otherwise("-1.5")).alias("place"),
        F.col("event_type").alias("kind"),
    )


_STAMP = """CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('day', ts)
  WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('millisecond', ts) END"""


@query("cast_common", f"""SELECT event_id, {_STAMP} AS Event_DateTime, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS INT) END AS users,
  CASE WHEN event_id % 2 = 0 THEN TRUE WHEN event_id % 3 <> 0 THEN FALSE END AS flag,
  CAST(value AS DECIMAL(18,2)) AS amount,
  CASE WHEN event_id % 7 <> 0 THEN CAST(CAST(event_id % 90 AS DOUBLE) AS VARCHAR) || ',-1.5' END AS place, event_type AS kind
FROM events""")
def common(spark: SparkSession, sf: str) -> DataFrame:
    types = {
        "Event_DateTime": "date", "users": "integer", "flag": "boolean", "amount": "scaled_float", "place": "geo_point", "kind": "keyword",
    }
    return cast_common(_dated(spark, sf), types)


@query("cast_dates_by_name", f"SELECT event_id, {_STAMP} AS Event_DateTime, event_type AS kind FROM events")
def dates_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return cast_dates_by_name(_dated(spark, sf).select("event_id", "Event_DateTime", "kind"))


@query("keyword_copy", "SELECT page_id, url, CASE WHEN length(url) <= 40 THEN url END AS url_keyword FROM pages")
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    return with_keyword(table(spark, sf, "pages").select("page_id", "url"), "url", 40)


def scrub_sql(column: str) -> str:
    for pattern, replacement in CLINICAL_SCRUB_RULES:
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'gi')"
    return column


@query("scrubbed_text", f"SELECT doc_id, {scrub_sql('text')} AS text FROM documents")
def scrubbed(spark: SparkSession, sf: str) -> DataFrame:
    return scrub_text(table(spark, sf, "documents").select("doc_id", "text"))


TERMS = ["and", "que", "The"]


@query("matched_text", r"""SELECT doc_id FROM documents
WHERE list_has_any(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['and', 'que', 'the'])""")
def matched(spark: SparkSession, sf: str) -> DataFrame:
    return match_text(table(spark, sf, "documents"), "text", TERMS).select("doc_id")


@query("decoded_text", "SELECT doc_id, text FROM documents")
def decoded(spark: SparkSession, sf: str) -> DataFrame:
    # Text of one-byte characters is stored as such, the rest as UTF-8.
    one_byte = ~F.col("text").rlike(r"[^\x00-\x7F -ÿ]")
    stored = F.when(one_byte, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", decode_with_fallback(stored).alias("text"))


#: The documents' languages can be written in each of these.
CHARSETS = ("utf-8", "windows-1252", "iso-8859-15", "cp850", "utf-16", "gb18030", "mac-roman")


@F.pandas_udf(T.BinaryType())
def _encoded(texts: pd.Series, charsets: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode(c, "replace") for t, c in zip(texts, charsets)])


@query("text_in_any_charset", "SELECT doc_id, text FROM documents")
def any_charset(spark: SparkSession, sf: str) -> DataFrame:
    """Each document stored in one of several charsets, and read by its name."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    number = F.col("doc_id") % len(CHARSETS)
    charset = F.coalesce(*[F.when(number == i, F.lit(c)) for i, c in enumerate(CHARSETS)])
    stored = docs.select("doc_id", charset.alias("charset"), _encoded(F.col("text"), charset).alias("stored"))
    text = F.coalesce(*[decode_with_fallback(F.when(F.col("charset") == c, F.col("stored")), [c]) for c in CHARSETS])
    return stored.select("doc_id", text.alias("text"))
