"""Queries on near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import fuzzylines, jaccard, trie
from chartloom.llm.common import table
from chartloom.llm.registry import query


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_copies")


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = fuzzylines.drop_repeated_lines(docs, fold_digits=False)
    return kept.select("doc_id", "n_dropped", F.char_length("text").cast("long").alias("n_chars"), "text")


@query("op11_simhash_trie")
def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return trie.near_duplicates(docs).select("doc_id", trie.as_hex(F.col("code")).alias("fingerprint"), "component_id")
