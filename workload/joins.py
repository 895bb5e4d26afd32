"""View, lookup and metadata join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import (
    add_geolocation,
    annotation_star,
    entity_view,
    join_metadata,
    map_codes,
    patient_encounters,
)
from workload import query
from workload.inputs import table


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as patients."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("last"),
        F.col("c_mktsegment").alias("ethnicity"),
        F.col("c_nationkey").alias("zip"),
    )


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as encounters."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("start"),
        F.col("o_custkey").alias("patient"),
        F.col("o_orderpriority").alias("code"),
        F.col("o_totalprice").alias("cost"),
        F.col("o_orderstatus").alias("reasoncode"),
    )


_VIEW = """
view_ AS (
  SELECT c_custkey AS patient_id, c_name AS patient_last_name, c_mktsegment AS patient_ethnicity, c_nationkey AS patient_zip,
         o_orderkey AS encounter_id, o_orderdate AS encounter_start, o_orderpriority AS encounter_code,
         o_totalprice AS encounter_cost, o_orderstatus AS encounter_reason_code
  FROM customer JOIN orders ON o_custkey = c_custkey)
"""


@query("patient_encounters", f"WITH {_VIEW} SELECT * FROM view_")
def encounters(spark: SparkSession, sf: str) -> DataFrame:
    return patient_encounters(people(spark, sf), visits(spark, sf))


# The columns of each entity beside key, time, patient and encounter, as
# expressions over line items that both engines read.
ENTITY_COLUMNS = {
    "allergies": {"code": "l_returnflag", "description": "l_linestatus"},
    "careplans": {"id": "l_orderkey * 10 + l_linenumber", "code": "l_returnflag", "reasoncode": "l_linestatus"},
    "conditions": {"start": "l_shipdate", "code": "l_linestatus", "description": "l_returnflag"},
    "imaging_studies": {"id": "l_orderkey * 10 + l_linenumber", "bodysite_code": "l_partkey", "modality_code": "l_returnflag", "sop_code": "l_suppkey"},
    "immunizations": {"date": "l_shipdate", "code": "l_returnflag", "cost": "l_extendedprice"},
    "medications": {"code": "l_returnflag", "cost": "l_extendedprice", "dispenses": "l_quantity", "totalcost": "l_extendedprice", "reasoncode": "l_linestatus"},
    "observations": {"doc_id": "l_partkey", "code": "l_returnflag", "value": "l_quantity", "units": "l_linestatus"},
    "procedures": {"date": "l_shipdate", "code": "l_linestatus", "cost": "l_tax", "reasoncode": "l_returnflag"},
}


def _register_entity(name: str, columns: dict[str, str]) -> None:
    picked = ", ".join(f"{expr} AS {column}" for column, expr in columns.items())
    sql = f"""WITH {_VIEW}, entity AS (
      SELECT l_orderkey * 10 + l_linenumber AS cid, l_shipdate AS created, o_custkey AS patient, l_orderkey AS encounter, {picked}
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT v.*, e.*, e.cid AS cog_pk, e.created AS cog_timestamp
    FROM view_ v JOIN entity e ON e.patient = v.patient_id AND e.encounter = v.encounter_id"""

    @query(f"{name}_view", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("patient"))
        entity = table(spark, sf, "lineitem").join(owner, "l_orderkey").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cid"),
            F.col("l_shipdate").alias("created"),
            "patient",
            F.col("l_orderkey").alias("encounter"),
            *[F.expr(expr).alias(column) for column, expr in columns.items()],
        )
        return entity_view(patient_encounters(people(spark, sf), visits(spark, sf)), entity)


for _name, _columns in ENTITY_COLUMNS.items():
    _register_entity(_name, _columns)


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as the postcode lookup: repeated keys, text that is no number."""
    n = F.col("n_nationkey")
    base = table(spark, sf, "nation").select(
        F.replace("n_name", F.lit("_"), F.lit("")).alias("postcode_no_space"),
        F.when(n % 7 == 3, "NULL").otherwise((n * 1.5 + 40).cast("string")).alias("latitude"),
        F.when(n % 5 == 0, F.lit(" 0.000125 ")).otherwise((n * -0.25).cast("string")).alias("longitude"),
        n.alias("ordinal"),
    )
    again = base.filter(F.col("ordinal") % 6 == 1).withColumn("latitude", F.lit("7")).withColumn("ordinal", F.col("ordinal") + 100)
    return base.filter(F.col("ordinal") % 8 != 5).unionByName(again)


def residents(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the nation's name as a postcode, spaces and all."""
    nation = F.col("c_nationkey").cast("string")
    key = F.col("c_custkey")
    code = (
        F.when(key % 7 == 0, F.lit(None).cast("string"))
        .when(key % 7 == 1, F.lit(""))
        .when(key % 7 == 2, F.concat(F.lit("nation"), nation))
        .when(key % 7 == 3, F.concat(F.lit(" NATI ON "), nation))
        .otherwise(F.concat(F.lit("NATION"), nation))
    )
    return table(spark, sf, "customer").select(key.alias("id"), code.alias("address_postcode"))


_GEO = """
people AS (
  SELECT c_custkey AS id, c_nationkey AS n,
    CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nation' || c_nationkey WHEN 3 THEN ' NATI ON ' || c_nationkey
      ELSE 'NATION' || c_nationkey END AS address_postcode FROM customer),
placed AS (
  SELECT *, coalesce(replace(address_postcode, ' ', '') = 'NATION' || n, FALSE)
              AND (n % 8 <> 5 OR n % 6 = 1) AS hit,
    CASE WHEN n % 6 = 1 THEN '7.0' WHEN n % 7 = 3 THEN NULL ELSE CAST(n * 1.5 + 40 AS VARCHAR) END AS lat,
    CASE WHEN n % 5 = 0 THEN '0.000125' ELSE CAST(CAST(n * -0.25 AS DOUBLE) AS VARCHAR) END AS lon FROM people),
located AS (
  SELECT id, address_postcode, CASE WHEN hit THEN CAST(CAST(lat AS DOUBLE) AS VARCHAR) || ',' || lon END AS address_geolocation,
    hit AND lat IS NULL AS geolocation_error FROM placed)
"""


@query("geolocation", f"WITH {_GEO} SELECT * FROM located")
def geolocation(spark: SparkSession, sf: str) -> DataFrame:
    return add_geolocation(residents(spark, sf), places(spark, sf))


@query("geolocation_counts", f"""WITH {_GEO} SELECT count(*) AS record_count,
  count(*) FILTER (geolocation_error) AS error_count, count(address_geolocation) AS located_count FROM located""")
def geolocation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return add_geolocation(residents(spark, sf), places(spark, sf)).agg(
        F.count("*").alias("record_count"), F.count_if("geolocation_error").alias("error_count"),
        F.count("address_geolocation").alias("located_count"),
    )


@query("files_with_metadata", """
SELECT '/in/' || source AS folder, 'doc.' || l.doc_id AS file_name_id_no_ext, coalesce(CAST(nullif(quality, 0) AS VARCHAR), '') AS quality,
  to_base64(encode(text)) AS binarydoc, '' AS text
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def files_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    files = docs.select(
        F.concat(F.lit("/in/"), "source").alias("folder"),
        F.concat(F.lit("doc."), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.encode("text", "UTF-8").alias("content"),
    )
    labels = table(spark, sf, "labels").join(docs.select("doc_id", "source"), "doc_id", "left")
    metadata = labels.select(
        F.concat(F.lit("/in/"), "source").alias("folder"),
        F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("file_name_id_no_ext"),
        F.nullif("quality", F.lit(0)).cast("string").alias("quality"),
    )
    return join_metadata(files, metadata)


@query("mapped_codes", """
SELECT c_custkey, coalesce(label, c_mktsegment) AS c_mktsegment FROM customer
LEFT JOIN (VALUES ('BUILDING', 'trades'), ('MACHINERY', 'industry')) AS m(code, label) ON code = c_mktsegment""")
def mapped_codes(spark: SparkSession, sf: str) -> DataFrame:
    codes = spark.createDataFrame([("BUILDING", "trades"), ("MACHINERY", "industry")], "code string, label string")
    return map_codes(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", codes)


@query("annotation_star", """
SELECT o_custkey AS document_id, o_orderstatus AS doc_status, event_id AS ann_id, event_type AS ann_label,
  props AS meta_value, value AS meta_confidence, s_suppkey AS model_id_used, s_name AS model_name
FROM orders JOIN events ON event_id // 4 = o_orderkey JOIN supplier ON s_suppkey = user_id % 10""")
def star(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_key"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status")
    )
    events = table(spark, sf, "events")
    anns = events.select(
        F.col("event_id").alias("id"), F.expr("event_id div 4").alias("document_key"), F.col("event_type").alias("label"),
        (F.col("user_id") % 10).alias("model_id_used"),
    )
    meta = events.select(F.col("event_id").alias("annotation_id"), F.col("props").alias("value"), F.col("value").alias("confidence"))
    models = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    rows = annotation_star(docs, anns, meta, models, document_key="document_key")
    return rows.select(
        F.col("doc_id").alias("document_id"), "doc_status", "ann_id", "ann_label", "meta_value", "meta_confidence",
        "model_id_used", "model_name",
    )
