"""Ledger, upsert, incremental and list queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import (
    bucket_ledger,
    explode_records,
    fetch_by_ids,
    ids_csv,
    incremental,
    ingest_counts,
    ledger_rows,
    limit_batch,
    not_yet_processed,
    terms,
    union_all,
    upsert,
    with_ordinal,
)
from chartloom.sources import read_ndjson, write_ndjson
from workload import query
from workload.inputs import table
from workload.scratch import scratch


@query("not_yet_processed", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def pending(spark: SparkSession, sf: str) -> DataFrame:
    ledger = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return not_yet_processed(table(spark, sf, "documents").select("doc_id", "lang"), ledger, "doc_id")


@query("ledger_rows", "SELECT conv_id || '_' || turn AS id, CAST(conv_id AS VARCHAR) AS document_id FROM conversations")
def stored(spark: SparkSession, sf: str) -> DataFrame:
    return ledger_rows(table(spark, sf, "conversations"), F.col("conv_id"), F.col("turn"))


@query("fetch_by_ids", "SELECT l.* FROM lineitem l SEMI JOIN (SELECT doc_id FROM labels) s ON s.doc_id = l.l_orderkey")
def fetched(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("l_orderkey"))
    return fetch_by_ids(table(spark, sf, "lineitem"), ids, "l_orderkey", "l_linenumber")


@query("upserted_table", """
WITH updates AS (SELECT l_orderkey AS k, max(CAST(l_partkey AS BIGINT) * 1000000 + l_suppkey * 100 + l_linenumber) AS pos FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, coalesce('line ' || pos, o_orderstatus) AS status, coalesce(pos, 0) AS pos
FROM orders LEFT JOIN updates ON k = o_orderkey""")
def upserted(spark: SparkSession, sf: str) -> DataFrame:
    target = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(0).cast("bigint").alias("pos"))
    pos = F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    updates = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("line "), pos.cast("string")).alias("status"), pos.alias("pos"))
    return upsert(target, updates, "id", "pos")


LAST_SEEN = "1998-01-01"


@query("incremental_rows", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '{LAST_SEEN}'")
def new_rows(spark: SparkSession, sf: str) -> DataFrame:
    last = datetime.datetime.fromisoformat(LAST_SEEN)
    return incremental(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", last)[0]


@query("high_water_mark", "SELECT max(o_orderkey) AS high_water FROM orders")
def mark(spark: SparkSession, sf: str) -> DataFrame:
    return incremental(table(spark, sf, "orders"), "o_orderkey", 100)[1]


BATCH = 5


@query("ids_as_csv", f"""
SELECT p_brand, CAST((nth - 1) // {BATCH} AS BIGINT) AS slice, string_agg(id, ',' ORDER BY p_partkey) AS ids_csv,
  count(*) AS ids_count, length(string_agg(id, ',' ORDER BY p_partkey)) AS ids_len
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth
      FROM (SELECT p_brand, p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'x' || p_size WHEN 3 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS id FROM part)
      WHERE regexp_full_match(id, '[0-9]+')) GROUP BY ALL""")
def csv_ids(spark: SparkSession, sf: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    raw = F.when(key % 4 == 1, F.concat(F.lit("x"), size)).when(key % 4 != 3, F.concat(F.lit(" "), size, F.lit("\t")))
    rows = table(spark, sf, "part").select("p_brand", key, raw.alias("id"))
    return ids_csv(rows, "id", "p_partkey", ["p_brand"], max_ids=BATCH)


@query("ids_as_csv_distinct", f"""
SELECT p_brand, CAST((nth - 1) // {BATCH} AS BIGINT) AS slice, string_agg(id, ',' ORDER BY pos) AS ids_csv, count(*) AS ids_count,
  length(string_agg(id, ',' ORDER BY pos)) AS ids_len
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS nth
      FROM (SELECT p_brand, CAST(p_size AS VARCHAR) AS id, min(p_partkey) AS pos FROM part GROUP BY ALL)) GROUP BY ALL""")
def csv_ids_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return ids_csv(table(spark, sf, "part"), "p_size", "p_partkey", ["p_brand"], max_ids=BATCH, distinct=True)


@query("terms_buckets", "SELECT event_type AS key, count(*) AS doc_count FROM events GROUP BY event_type")
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    return terms(table(spark, sf, "events"), "event_type")


@query("top_terms", "SELECT user_id AS key, count(*) AS doc_count FROM events GROUP BY user_id ORDER BY doc_count DESC, key LIMIT 10")
def top_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return terms(table(spark, sf, "events"), "user_id", size=10)


@query("bucket_ledger", "SELECT DISTINCT lang || '_1' AS id, lang AS document_id FROM documents")
def buckets_stored(spark: SparkSession, sf: str) -> DataFrame:
    return bucket_ledger(terms(table(spark, sf, "documents"), "lang"))


@query("ingest_counts", "SELECT source AS folder, count(*) AS n_files FROM documents GROUP BY ROLLUP (source)")
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_counts(table(spark, sf, "documents").withColumnRenamed("source", "folder"))


@query("union_of_inputs", """
SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS segment FROM orders
UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier""")
def unioned(spark: SparkSession, sf: str) -> DataFrame:
    return union_all([
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
        table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id")),
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")),
    ])


@query("exploded_records", """
SELECT l_orderkey, 'q' AS kind, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, 'd', l_discount FROM lineitem""")
def exploded(spark: SparkSession, sf: str) -> DataFrame:
    def item(kind: str, amount: str) -> F.Column:
        return F.struct(F.col("l_orderkey"), F.lit(kind).alias("kind"), F.col(amount).alias("amount"))

    units = table(spark, sf, "lineitem").select(F.array(item("q", "l_quantity"), item("d", "l_discount")).alias("records"))
    return explode_records(units, "records")


@query("limited_batch", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 100")
def limited(spark: SparkSession, sf: str) -> DataFrame:
    return limit_batch(table(spark, sf, "documents").select("doc_id", "source"), 100, ["source", "doc_id"])


@query("ordinal_ids", "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS ordinal, c_custkey, c_acctbal FROM customer")
def ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return with_ordinal(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"])


@query("ndjson_round_trip", """SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders""")
def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "ndjson")
    write_ndjson(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"), path)
    return read_ndjson(spark, path, "o_orderkey bigint, o_totalprice double, o_orderdate string, o_orderpriority string")[0]


def _damaged(spark: SparkSession, sf: str) -> str:
    """Documents as lines of JSON, some cut short, some with text where a number belongs."""
    doc, path = F.col("doc_id"), scratch(spark, "damaged")
    line = F.to_json(F.struct("doc_id", F.when(doc % 11 == 0, F.lit("many")).otherwise(F.col("n_chars").cast("string")).alias("n_chars")))
    number = F.regexp_replace(line, r'"n_chars":"(\d+)"', r'"n_chars":$1')
    lines = F.when(doc % 7 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    table(spark, sf, "documents").select("doc_id", number.alias("line")).select(lines.alias("value")).write.text(path)
    return path


@query("damaged_lines_read", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def damaged_good(spark: SparkSession, sf: str) -> DataFrame:
    return read_ndjson(spark, _damaged(spark, sf), "doc_id bigint, n_chars bigint")[0]


@query("damaged_lines_failed", """
SELECT CASE WHEN doc_id % 7 = 0 THEN substr(line, 1, length(line) - 3) ELSE line END AS text, 'not JSON, or not of the schema' AS error
FROM (SELECT doc_id, '{"doc_id":' || doc_id || ',"n_chars":' || CASE WHEN doc_id % 11 = 0 THEN '"many"' ELSE CAST(n_chars AS VARCHAR) END || '}' AS line
      FROM documents) WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""")
def damaged_failed(spark: SparkSession, sf: str) -> DataFrame:
    return read_ndjson(spark, _damaged(spark, sf), "doc_id bigint, n_chars bigint")[1].select("text", "error")
