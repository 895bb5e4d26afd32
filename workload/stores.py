"""Queries on what is kept between runs: keyed tables, partial results, marks, a text index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import affirmed, cui_patient_facts, match_indexed, write_text_index
from chartloom.sources import (
    MarkLog,
    create_keyed,
    file_marks,
    merge_files,
    merged_partials,
    read_keyed,
    replace_keyed,
    run_batches,
    upsert_keyed,
    versioned_parquet,
)
from workload import query
from workload.inputs import ANNOTATIONS_SQL, annotations, doc2ptt, table
from workload.scratch import scratch


@query("keyed_versions", """
WITH updates AS (
  SELECT l_orderkey AS id, max(l_linenumber) AS lines FROM lineitem WHERE l_orderkey % 100 = 0 GROUP BY l_orderkey)
SELECT 0 AS version, o_orderkey AS id, o_orderstatus AS status, 0 AS lines FROM orders
UNION ALL SELECT 1, o_orderkey, CASE WHEN u.id IS NULL THEN o_orderstatus ELSE 'counted' END, coalesce(u.lines, 0)
FROM orders LEFT JOIN updates u ON u.id = o_orderkey
UNION ALL SELECT 2, o_orderkey, CASE WHEN u.id IS NULL THEN o_orderstatus ELSE 'counted' END, coalesce(u.lines, 0)
FROM orders LEFT JOIN updates u ON u.id = o_orderkey
UNION ALL SELECT 2, -1 - c_custkey, 'new', NULL FROM customer WHERE c_custkey % 10 = 0""")
def keyed_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a keyed table: 1 % of them updated by their lines, then new keys."""
    path = scratch(spark, "keyed")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("lines"))
    create_keyed(orders, path, "id", buckets=16)
    lines = table(spark, sf, "lineitem").filter("l_orderkey % 100 = 0")
    upsert_keyed(lines.select(F.col("l_orderkey").alias("id"), F.lit("counted").alias("status"), F.col("l_linenumber").cast("int").alias("lines")), path, "lines")
    new = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select((-1 - F.col("c_custkey")).alias("id"), F.lit("new").alias("status"))
    upsert_keyed(new, path, "id")
    whole = [read_keyed(spark, path, v).select(F.lit(v).alias("version"), "id", "status", "lines") for v in range(3)]
    return whole[0].union(whole[1]).union(whole[2])


@query("keyed_replaced", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 0
UNION ALL SELECT l_orderkey, -l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber > 1""")
def keyed_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """All lines of some orders in place of those the table had."""
    path = scratch(spark, "replaced")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    # The first line of an order stays to tell the keys; the second write holds the orders with more.
    create_keyed(lines, path, "l_orderkey", buckets=8)
    gone = lines.filter("l_orderkey % 7 = 0").select("l_orderkey", F.lit(None).cast("long").alias("l_linenumber"), "l_quantity")
    replace_keyed(gone, path)
    replace_keyed(lines.filter("l_orderkey % 7 = 0").withColumn("l_linenumber", -F.col("l_linenumber")), path)
    return read_keyed(spark, path).filter("l_orderkey % 7 <> 0 OR l_linenumber < -1")


@query("replaced_partials", f"""WITH {ANNOTATIONS_SQL}
SELECT a.cui, o.o_custkey AS patient, count(*) AS n, min(CAST(round_even(epoch_us(a.ts) / 1e6, 0) AS BIGINT)) AS first_seen
FROM affirmed a JOIN orders o ON o.o_orderkey = a.docid
WHERE a.ann_id % 5 <> 4 AND (a.ann_id % 5 <> 3 OR a.ann_id % 2 = 0) GROUP BY a.cui, o.o_custkey""")
def replaced_partials(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations in five files, each merged on its own: file 1 comes twice, file 3 again with half its rows, file 4 again with none that count."""
    path, mentions = scratch(spark, "partials"), annotations(spark, sf).withColumn("file", F.concat(F.lit("f"), F.col("ann_id") % 5))
    documents = doc2ptt(spark, sf)

    def merge(rows: DataFrame) -> None:
        names = [r["file"] for r in rows.select("file").distinct().collect()]
        parts = [cui_patient_facts(affirmed(rows.filter(F.col("file") == n)), documents).withColumn("file", F.lit(n)) for n in sorted(names)]
        facts = parts[0]
        for more in parts[1:]:
            facts = facts.union(more)
        marks = file_marks(rows, "file")
        merge_files(facts, marks, path, buckets=4)

    merge(mentions)
    merge(mentions.filter("file = 'f1'"))
    merge(mentions.filter("file = 'f3' AND ann_id % 2 = 0"))
    future = F.col("meta_anns").withField("Time", F.struct(F.lit("Future").alias("value"), F.lit(1.0).alias("confidence")))
    merge(mentions.filter("file = 'f4'").withColumn("meta_anns", future))
    return merged_partials(spark, path)


@query("resumed_batches", """
SELECT o_orderkey, CASE WHEN o_orderkey <= m / 3 THEN 0 WHEN o_orderkey <= 2 * m / 3 THEN 1 ELSE 2 END AS version
FROM orders, (SELECT max(o_orderkey) AS m FROM orders)""")
def resumed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A table that grows between three runs; the second run dies after it wrote and before it said so."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    most = orders.agg(F.max("o_orderkey")).first()[0]
    log, out = MarkLog(spark, scratch(spark, "marks")), scratch(spark, "batches")

    def upto(third: int) -> DataFrame:
        return orders.filter(F.col("o_orderkey") * 3 <= third * most)

    run_batches(log, lambda: upto(1), "o_orderkey", versioned_parquet(out))
    lost = log.next_batch(upto(2), "o_orderkey")
    versioned_parquet(out)(lost.rows, lost.version)  # and dies here
    run_batches(log, lambda: upto(3), "o_orderkey", versioned_parquet(out))
    return spark.read.parquet(out).select("o_orderkey", "version")


INDEXED = ["and", "que", "The"]


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    docs, path = table(spark, sf, "documents").select("doc_id", "text"), scratch(spark, "index")
    for part in (0, 1, 1):  # a segment written again is the same
        write_text_index(docs.filter(F.col("doc_id") % 2 == part), "doc_id", "text", path, str(part))
    return docs, path


@query("matched_by_index", r"""SELECT doc_id FROM documents
WHERE list_has_any(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['and', 'que', 'the'])""")
def matched_by_index(spark: SparkSession, sf: str) -> DataFrame:
    docs, path = _indexed(spark, sf)
    return match_indexed(docs, path, "doc_id", "text", INDEXED).select("doc_id")


@query("phrases_by_index", r"""
WITH spaced AS (SELECT doc_id, regexp_replace(' ' || lower(text) || ' ', '[^\p{L}\p{N}]+', ' ', 'g') AS t FROM documents)
SELECT doc_id FROM spaced WHERE contains(t, ' of the ') AND contains(t, ' the ')""")
def phrases_by_index(spark: SparkSession, sf: str) -> DataFrame:
    docs, path = _indexed(spark, sf)
    return match_indexed(docs, path, "doc_id", "text", ["of -- The", "the"], every=True).select("doc_id")
