"""Queries whose operators work on whole texts inside Arrow batches."""

from __future__ import annotations

import importlib.util
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import bpe, fmindex, html, langid
from chartloom.llm.common import LOWER, UPPER, table
from chartloom.llm.registry import query


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file: in $TOKENIZERS_DIR, else beside the installed package."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return str(Path(folder, name))
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None:
        return str(Path("/opt/tokenizers", name))
    return importlib.import_module("public_tokenizers").path(name)


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


LEAKS_SQL = f"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least({fmindex.WINDOW}, len(w)) AS n, w[i:i + least({fmindex.WINDOW}, len(w)) - 1] AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least({fmindex.WINDOW}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT row, i, n, w[i:i + n - 1] AS win
  FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT row, i, n, item FROM grams JOIN windows USING (n, win)),
covered AS (
  SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, i + unnest(range(0, n)) AS pos FROM hits) GROUP BY row),
named AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""


@query("op4_benchmark_decontamination", LEAKS_SQL)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leak = F.col("leak")
    return fmindex.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        leak["n_words"].alias("n_words"),
        leak["n_hit"].alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(leak["items"], ","), "UTF-8"), 256).alias("items_sha256"),
        (leak["n_hit"] > 0).alias("contaminated"),
    )


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    profiles = langid.learn(docs.filter(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), profiles).drop("text")


@query("op8_bpe_codec")
def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, vocabulary_path())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
