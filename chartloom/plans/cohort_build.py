"""Cohort build: patient records and annotations to the cohort artefacts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from chartloom.operators.cohort import (
    PatientColumns,
    cui_patient_facts,
    dims_of,
    doc_to_patient,
    patient_table,
    split_affirmed,
)
from chartloom.operators.requests import unwrap_hit
from chartloom.sources.sinks import write_dict_json, write_dict_jsonl, write_failures


@dataclass
class CohortResult:
    """Patient dimensions, mention facts per concept and patient, unusable annotations."""

    dims: dict[str, DataFrame]
    patients: DataFrame
    facts: DataFrame
    failed: DataFrame
    extras: dict[str, DataFrame] = field(default_factory=dict)


def build_cohort(
    patients: DataFrame,
    annotations: DataFrame,
    as_of: Column,
    cols: PatientColumns = PatientColumns(),
    doc_col: str = "docid",
    cui_col: str = "cui",
    meta_col: str = "meta_anns",
    ts_col: str | None = "timestamp",
    **patient_options: object,
) -> CohortResult:
    """Two shuffles of size: mentions by document and concept, facts by concept and patient."""
    people = patient_table(patients, as_of, cols, **patient_options)
    dims = dims_of(people) | {"doc2ptt": doc_to_patient(patients, cols)}
    records = unwrap_hit(annotations, ["_source"])
    good, failed = split_affirmed(records, meta_col)
    known = dims["doc2ptt"].withColumnRenamed("docid", doc_col)
    facts = cui_patient_facts(good, known, cui_col, doc_col, ts_col)
    return CohortResult(dims, people, facts, failed)


def write_cohort(result: CohortResult, folder: str) -> None:
    """The artefacts: ``ptt2*.json``, ``doc2ptt.json``, ``cui2ptt_pos`` and ``cui2ptt_tsp`` lines."""
    # Stored once: six artefacts come from one pass over the patient records.
    spark = result.facts.sparkSession
    stored = {}
    for name, df in (("patients", result.patients), ("doc2ptt", result.dims["doc2ptt"])):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        stored[name] = spark.read.parquet(f"{folder}/{name}.parquet")
    dims = dims_of(stored["patients"])
    short = {"sex": "sex", "ethnicity": "eth", "dob": "dob", "dod": "dod", "age": "age"}
    for name, suffix in short.items():
        write_dict_json(dims[name], "patient", name, f"{folder}/ptt2{suffix}.json")
    write_dict_json(stored["doc2ptt"], "docid", "patient", f"{folder}/doc2ptt.json")
    # Stored once, read twice: the two artefacts come from one pass over the mentions.
    result.facts.write.mode("overwrite").parquet(f"{folder}/cui2ptt.parquet")
    facts = spark.read.parquet(f"{folder}/cui2ptt.parquet")
    write_dict_jsonl(facts, "cui", "patient", "n", f"{folder}/cui2ptt_pos.jsonl")
    write_dict_jsonl(facts.filter("first_seen IS NOT NULL"), "cui", "patient", "first_seen", f"{folder}/cui2ptt_tsp.jsonl")
    write_failures(result.failed, f"{folder}/failures", "affirmed")
