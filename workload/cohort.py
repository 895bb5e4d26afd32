"""Cohort queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import (
    affirmed,
    cui_patient_counts,
    cui_patient_facts,
    cui_patient_first_seen,
    doc_to_patient,
    merge_counts,
    patient_dims,
    patient_table,
    split_affirmed,
    to_nested_map,
)
from chartloom.plans import CohortResult, build_cohort
from chartloom.sources.sinks import dict_json, dict_jsonl
from workload import query
from workload.inputs import ANNOTATIONS_SQL, PATIENTS_SQL, annotations, doc2ptt, patients

def _as_of() -> F.Column:
    return F.expr("TIMESTAMP_NTZ'2024-06-30 00:00:00'")


@query("affirmed_mentions", f"WITH {ANNOTATIONS_SQL} SELECT ann_id, docid, cui FROM affirmed")
def affirmed_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return affirmed(annotations(spark, sf)).select("ann_id", "docid", "cui")


@query("incomplete_mentions", f"""WITH {ANNOTATIONS_SQL}
SELECT ann_id, 'no Time' AS error FROM checked WHERE is_patient AND is_present AND NOT has_time""")
def incomplete_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return split_affirmed(annotations(spark, sf))[1].select("ann_id", "error")


@query("cohort_mention_counts", f"WITH {ANNOTATIONS_SQL} SELECT cui, patient, n FROM facts")
def cohort_mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cui_patient_counts(affirmed(annotations(spark, sf)), doc2ptt(spark, sf))


@query("cohort_first_mentions", f"WITH {ANNOTATIONS_SQL} SELECT cui, patient, first_seen FROM facts")
def cohort_first_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return cui_patient_first_seen(affirmed(annotations(spark, sf)), doc2ptt(spark, sf))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return cui_patient_facts(affirmed(annotations(spark, sf)), doc2ptt(spark, sf))


@query("cohort_merged_partials", f"WITH {ANNOTATIONS_SQL} SELECT * FROM facts")
def cohort_merged_partials(spark: SparkSession, sf: str) -> DataFrame:
    mentions, known = affirmed(annotations(spark, sf)), doc2ptt(spark, sf)
    low, high = mentions.filter("score < 20"), mentions.filter("NOT score < 20")
    return merge_counts([cui_patient_facts(low, known), cui_patient_facts(high, known)])


MAP_ENTRIES = 100
PART_OF = "CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {parts}"


@query("cohort_nested_map", f"""WITH {ANNOTATIONS_SQL},
sized AS (SELECT cui, CAST(ceil(count(*) / {MAP_ENTRIES}.0) AS BIGINT) AS parts FROM facts GROUP BY cui)
SELECT f.cui, {PART_OF.format(key='patient', parts='parts')} AS part, CAST(patient AS VARCHAR) AS patient, n
FROM facts f JOIN sized s ON s.cui = f.cui""")
def cohort_nested_map(spark: SparkSession, sf: str) -> DataFrame:
    nested = to_nested_map(facts(spark, sf), "cui", "patient", "n", MAP_ENTRIES)
    return nested.select("cui", "part", F.explode("entries").alias("patient", "n"))


@query("cohort_count_lines", f"""WITH {ANNOTATIONS_SQL},
sized AS (SELECT cui, CAST(ceil(count(*) / {MAP_ENTRIES}.0) AS BIGINT) AS parts FROM facts GROUP BY cui),
placed AS (SELECT f.*, {PART_OF.format(key='patient', parts='parts')} AS part FROM facts f JOIN sized s ON s.cui = f.cui)
SELECT '{{"' || cui || '":{{' ||
       string_agg('"' || patient || '":' || n, ',' ORDER BY CAST(patient AS VARCHAR)) || '}}}}' AS value
FROM placed GROUP BY cui, part""")
def cohort_count_lines(spark: SparkSession, sf: str) -> DataFrame:
    return dict_jsonl(facts(spark, sf), "cui", "patient", "n", MAP_ENTRIES).select("value")


_LATEST = f"""{PATIENTS_SQL},
who AS (SELECT patient, arg_max(sex, ordinal) AS sex, arg_max(ethnicity, ordinal) AS ethnicity FROM raw GROUP BY patient),
dated AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY ordinal DESC) AS r FROM raw WHERE NOT bad),
codes(code, label) AS (VALUES ('building group', 'trades and crafts'), ('machinery group', 'x-ray o''neil'),
                              ('furniture group', 'HOME goods')),
table_ AS (
  SELECT w.patient, w.sex, coalesce(c.label, w.ethnicity) AS ethnicity,
         CASE WHEN d.patient IS NOT NULL THEN coalesce(CAST(strftime(d.dob, '%Y%m%d%H%M%S') AS BIGINT), 0) END AS dob,
         CASE WHEN d.patient IS NOT NULL THEN coalesce(CAST(strftime(d.dod, '%Y%m%d%H%M%S') AS BIGINT), 0) END AS dod,
         CAST(abs(year(coalesce(d.dod, DATE '2024-06-30')) - year(d.dob)) AS INT) AS age,
         d.patient IS NOT NULL AS has_dates
  FROM who w LEFT JOIN dated d ON d.patient = w.patient AND d.r = 1 LEFT JOIN codes c ON c.code = w.ethnicity)"""

_TITLE = """CASE ethnicity WHEN 'x-ray o''neil' THEN 'X-Ray O''Neil'
  ELSE array_to_string(list_transform(string_split(ethnicity, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END"""


def codes(spark: SparkSession) -> DataFrame:
    """Three labels: a lookup the caller supplies."""
    rows = [("building group", "trades and crafts"), ("machinery group", "x-ray o'neil"), ("furniture group", "HOME goods")]
    return spark.createDataFrame(rows, "code string, label string")


@query("patient_table", f"""WITH {_LATEST}
SELECT patient, sex, {_TITLE} AS ethnicity, dob, dod, age, has_dates FROM table_""")
def patients_wide(spark: SparkSession, sf: str) -> DataFrame:
    return patient_table(patients(spark, sf), _as_of(), ethnicity_map=codes(spark))


@query("patient_ages", f"WITH {_LATEST} SELECT patient, age FROM table_ WHERE has_dates")
def patient_ages(spark: SparkSession, sf: str) -> DataFrame:
    return patient_dims(patients(spark, sf), _as_of())["age"]


@query("patient_age_limit", f"""WITH {_LATEST}
SELECT patient,
  CASE WHEN dod = 0 AND age >= 100 THEN -1 ELSE age END AS age,
  CASE WHEN dod = 0 AND age >= 100 THEN 20240630000000 ELSE dod END AS dod
FROM table_ WHERE has_dates""")
def patient_age_limit(spark: SparkSession, sf: str) -> DataFrame:
    limited = patient_table(patients(spark, sf), _as_of(), age_limit=True)
    return limited.filter("has_dates").select("patient", "age", "dod")


@query("patient_birth_default", f"""WITH {_LATEST}
SELECT patient, CASE WHEN dob = 0 THEN 19700101000000 ELSE dob END AS dob FROM table_ WHERE has_dates""")
def patient_birth_default(spark: SparkSession, sf: str) -> DataFrame:
    table = patient_table(patients(spark, sf), _as_of(), epoch_default=True)
    return table.filter("has_dates").select("patient", "dob")


@query("document_to_patient", f"WITH {PATIENTS_SQL} SELECT docid, patient FROM raw WHERE NOT bad")
def document_to_patient(spark: SparkSession, sf: str) -> DataFrame:
    return doc_to_patient(patients(spark, sf))


@query("patient_sex_artefact", f"""WITH {_LATEST}
SELECT '{{' || string_agg('"' || patient || '":"' || sex || '"', ',' ORDER BY patient) || '}}' AS value
FROM table_ GROUP BY {PART_OF.format(key='patient', parts='16')}""")
def patient_sex_artefact(spark: SparkSession, sf: str) -> DataFrame:
    return dict_json(patient_dims(patients(spark, sf), _as_of())["sex"], "patient", "sex", parts=16).select("value")


def _built(spark: SparkSession, sf: str) -> CohortResult:
    """The whole job: annotations as search hits, documents mapped by the patient records."""
    mentions = annotations(spark, sf)
    hits = mentions.select(F.struct(*mentions.columns).alias("_source"))
    return build_cohort(patients(spark, sf), hits, _as_of())


_BUILT = f"""{ANNOTATIONS_SQL}, {PATIENTS_SQL}, built AS (
  SELECT cui, patient, count(*) AS n, min(CAST(round_even(epoch_us(ts) / 1e6, 0) AS BIGINT)) AS first_seen
  FROM affirmed JOIN raw ON raw.docid = CAST(affirmed.docid AS VARCHAR) WHERE NOT bad GROUP BY cui, patient)"""


@query("cohort_build_facts", f"WITH {_BUILT} SELECT * FROM built")
def built_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).facts


@query("cohort_build_failures", f"""WITH {ANNOTATIONS_SQL}
SELECT ann_id, 'no Time' AS error FROM checked WHERE is_patient AND is_present AND NOT has_time""")
def built_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _built(spark, sf).failed.select("ann_id", "error")
