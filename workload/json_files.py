"""Queries on files of JSON that are read by byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.sources import read_json_ranges
from workload import query
from workload.inputs import table
from workload.scratch import scratch

SHAPE = "doc_id bigint, text string, inner struct<lang: string, tags: array<string>>"


def _arrays(spark: SparkSession, sf: str, damage: bool) -> str:
    """Documents as one array a source, each on a single line, with brackets and quote marks in their texts.

    With ``damage`` source 3 ends too early, source 4 has a number among the objects, and
    source 5 a text where a number belongs.
    """
    doc = F.col("doc_id")
    tags = F.array(F.lit('"},{'), F.lit("\\"), F.col("lang"))
    text = F.concat(F.lit('{"a": ["'), F.col("text"), F.lit('\\"}]'))
    whole = F.to_json(F.struct(doc, text.alias("text"), F.struct("lang", tags.alias("tags")).alias("inner")))
    ordered = Window.partitionBy("source").orderBy("doc_id")
    first, last = F.lag("doc_id").over(ordered).isNull(), F.lead("doc_id").over(ordered).isNull()
    rows = table(spark, sf, "documents").select("source", "doc_id", whole.alias("j"), first.alias("first"), last.alias("last"))
    number = (F.col("source") == "src4") & F.col("last") if damage else F.lit(False)
    early = (F.col("source") == "src3") & F.col("last") if damage else F.lit(False)
    odd = (F.col("source") == "src5") & F.col("last") if damage else F.lit(False)
    body = F.when(odd, F.lit('{"doc_id":"many"}')).otherwise(F.col("j"))
    line = F.concat(
        F.when(F.col("first"), "[").otherwise(","), body, F.when(number, ", 7").otherwise(""), F.when(F.col("last") & ~early, "]").otherwise("")
    )
    path = scratch(spark, "arrays")
    lines = rows.select("source", "doc_id", line.alias("value")).repartition("source").sortWithinPartitions("source", "doc_id")
    # A blank for the line's end: each file is one line, however long.
    lines.drop("doc_id").write.partitionBy("source").option("lineSep", " ").text(path)
    return path


_TEXT = "'{\"a\": [\"' || text || '\\\"}]'"


@query("json_array_ranges", f"SELECT doc_id, {_TEXT} AS text, lang, 3 AS n_tags FROM documents")
def array_ranges(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = read_json_ranges(spark, _arrays(spark, sf, damage=False), SHAPE)
    return good.select("doc_id", "text", F.col("inner.lang").alias("lang"), F.size("inner.tags").alias("n_tags"))


@query("json_array_ranges_damaged", """
SELECT doc_id FROM documents WHERE source NOT IN ('src3', 'src4', 'src5')""")
def array_ranges_damaged(spark: SparkSession, sf: str) -> DataFrame:
    return read_json_ranges(spark, _arrays(spark, sf, damage=True), SHAPE)[0].select("doc_id")


@query("json_array_ranges_failed", """
SELECT DISTINCT source, CASE source WHEN 'src3' THEN 'brackets or quote marks that don''t match'
  WHEN 'src4' THEN 'something that is no object beside the objects' ELSE 'not JSON, or not of the schema' END AS error,
  CASE source WHEN 'src4' THEN ', 7 ]' WHEN 'src5' THEN ',{"doc_id":"many"}' END AS text
FROM documents WHERE source IN ('src3', 'src4', 'src5')""")
def array_ranges_failed(spark: SparkSession, sf: str) -> DataFrame:
    failed = read_json_ranges(spark, _arrays(spark, sf, damage=True), SHAPE)[1]
    return failed.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "error", F.regexp_replace("text", r"\s*\]$", " ]").alias("text"))
