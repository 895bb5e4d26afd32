"""Schema mapper queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import map_schema, render_items
from workload import query
from workload.inputs import table


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with empty and missing values."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.col("c_nationkey").alias("nation"),
        (F.col("c_acctbal") > 0).alias("positive"),
        F.col("c_acctbal").alias("balance"),
    )


FLAT_MAPPING = {
    "patient_id": "id",
    "patient_key": "id",
    "patient_name": "name",
    "address": None,
    "nation": None,
    "summary": ["name", "segment", "nation", "positive", "balance", "absent"],
    "label": ["segment", "name", "nation"],
    "unused": "",
    "ignored": {},
}

_FLAT_SQL = """
flat AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name,
         CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment,
         c_nationkey AS nation, c_acctbal > 0 AS positive, c_acctbal AS balance
  FROM customer),
mapped AS (
  SELECT *, concat_ws(chr(10), name, nullif(segment, ''), nation, CASE WHEN positive THEN 'True' ELSE 'False' END, balance) AS summary,
         coalesce(nullif(segment, ''), name, CAST(nation AS VARCHAR)) AS label
  FROM flat)
"""


@query("map_schema", f"""WITH {_FLAT_SQL}
SELECT id AS patient_id, id AS patient_key, name AS patient_name, segment, nation, positive, balance,
       CAST(NULL AS VARCHAR) AS address, summary, label FROM mapped""")
def map_flat(spark: SparkSession, sf: str) -> DataFrame:
    return map_schema(_flat(spark, sf), FLAT_MAPPING, first_non_empty=["label"])


@query("map_schema_drop_unmapped", f"""WITH {_FLAT_SQL}
SELECT id AS patient_id, id AS patient_key, name AS patient_name, CAST(NULL AS VARCHAR) AS address,
       CAST(NULL AS VARCHAR) AS nation, summary, label FROM mapped""")
def map_drop(spark: SparkSession, sf: str) -> DataFrame:
    return map_schema(_flat(spark, sf), FLAT_MAPPING, preserve_unmapped=False, first_non_empty=["label"])


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as records with a list of fields, built within the row."""

    def field(label: str, text: F.Column, number: F.Column) -> F.Column:
        return F.struct(
            F.lit(label).alias("label"), text.alias("q_text"), number.alias("q_num"), F.col("l_returnflag").alias("flag")
        )

    none = F.lit(None).cast("string")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).alias("source"),
        F.array(
            field("quantity", none, F.col("l_quantity")),
            field("status", F.col("l_linestatus"), F.lit(None).cast("double")),
            field("", F.lit(""), F.lit(None).cast("double")),
            field("tax", F.when(F.col("l_tax") == 0, "none").otherwise("some"), F.col("l_tax")),
        ).alias("fields"),
    )


NESTED_MAPPING = {
    "order_id": "l_orderkey",
    "source.part_id": "part",
    "source.both": ["part", "supplier"],
    "fields.valueText": "q_text",
    "fields.valueNum": "q_num",
    "fields.valueDate": None,
}


@query("map_schema_nested", """
SELECT l_orderkey AS order_id, l_linenumber, l_partkey AS part_id, l_suppkey AS supplier,
       l_partkey || chr(10) || l_suppkey AS both_ids, pos, label, value_text, value_num,
       CAST(NULL AS VARCHAR) AS value_date, l_returnflag AS flag
FROM lineitem, (VALUES (0), (1), (2), (3)) AS p(pos),
LATERAL (SELECT
  CASE pos WHEN 0 THEN 'quantity' WHEN 1 THEN 'status' WHEN 2 THEN '' ELSE 'tax' END AS label,
  CASE pos WHEN 0 THEN NULL WHEN 1 THEN l_linestatus WHEN 2 THEN '' ELSE CASE WHEN l_tax = 0 THEN 'none' ELSE 'some' END END AS value_text,
  CASE pos WHEN 0 THEN l_quantity WHEN 3 THEN l_tax END AS value_num) AS v""")
def map_nested(spark: SparkSession, sf: str) -> DataFrame:
    mapped = map_schema(_nested(spark, sf), NESTED_MAPPING)
    rows = mapped.select("order_id", "l_linenumber", "source", F.posexplode("fields").alias("pos", "f"))
    return rows.select(
        "order_id", "l_linenumber", F.col("source.part_id").alias("part_id"), F.col("source.supplier").alias("supplier"),
        F.col("source.both").alias("both_ids"), "pos", F.col("f.label").alias("label"),
        F.col("f.valueText").alias("value_text"), F.col("f.valueNum").alias("value_num"),
        F.col("f.valueDate").alias("value_date"), F.col("f.flag").alias("flag"),
    )


@query("render_items", """
SELECT l_orderkey, l_linenumber,
  'quantity: ' || l_quantity || chr(10) || chr(10) || 'status: ' || l_linestatus || chr(10) || chr(10) ||
  'tax: ' || CASE WHEN l_tax = 0 THEN 'none' ELSE 'some' END || ' | ' || l_tax AS content
FROM lineitem""")
def render(spark: SparkSession, sf: str) -> DataFrame:
    rows = _nested(spark, sf)
    text = render_items(F.col("fields"), rows.schema["fields"].dataType, ["label", "q_text", "q_num"])
    return rows.select("l_orderkey", "l_linenumber", text.alias("content"))


@query("map_schema_item_text", """
SELECT l_orderkey AS order_id, l_linenumber || chr(10) || 'quantity' || chr(10) || chr(10) || 'status' ||
  chr(10) || chr(10) || 'tax' AS content
FROM lineitem""")
def map_item_text(spark: SparkSession, sf: str) -> DataFrame:
    mapping = {"order_id": "l_orderkey", "content": ["l_linenumber", "source", "fields"]}
    return map_schema(_nested(spark, sf), mapping, preserve_unmapped=False)
