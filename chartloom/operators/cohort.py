"""Cohort build: patient attributes, and concept mentions per patient."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.dates import age_and_death, is_bad_date, parse_date, ts_to_int
from chartloom.functions.ids import clean_id
from chartloom.functions.labels import norm_gender, norm_label, title_case
from chartloom.functions.names import named
from chartloom.operators.lookups import map_codes
from chartloom.operators.records import part_of, union_all


#: Entries of a map that one cell surely holds.
MAP_ENTRIES = 5_000_000


def _meta(df: DataFrame, meta_col: str, name: str) -> Column:
    """The meta annotation's value struct; null where the schema doesn't have it."""
    kind = df.schema[meta_col].dataType
    if isinstance(kind, T.StructType) and name not in kind.names:
        return F.lit(None).cast("struct<value:string>")
    return named(meta_col)[name]


def split_affirmed(df: DataFrame, meta_col: str = "meta_anns") -> tuple[DataFrame, DataFrame]:
    """(affirmed mentions of the patient, rows whose meta annotations are incomplete).

    Affirmed: Subject is ``Patient``, Presence is ``True`` and Time is anything
    but ``Future`` (no value is fine).  A missing meta annotation that would have
    been looked at makes the row a failure.
    """
    subject, presence, time = (_meta(df, meta_col, n) for n in ("Subject", "Presence", "Time"))
    is_patient = F.coalesce(subject["value"] == "Patient", F.lit(False))
    is_present = F.coalesce(presence["value"] == "True", F.lit(False))
    error = (
        F.when(subject.isNull(), "no Subject")
        .when(is_patient & presence.isNull(), "no Presence")
        .when(is_patient & is_present & time.isNull(), "no Time")
    )
    affirmed = is_patient & is_present & time.isNotNull() & ~time["value"].eqNullSafe(F.lit("Future"))
    return df.filter(affirmed), df.withColumn("error", error).filter(F.col("error").isNotNull())


def affirmed(df: DataFrame, meta_col: str = "meta_anns") -> DataFrame:
    """Affirmed mentions only."""
    return split_affirmed(df, meta_col)[0]


def epoch_seconds(col: Column, dtype: T.DataType) -> Column:
    """Whole seconds since 1970, half to even; text without a zone is UTC."""
    if isinstance(dtype, T.StringType):
        zoned = F.when(col.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), col).otherwise(F.concat(col, F.lit("Z")))
        micros = F.unix_micros(zoned.try_cast("timestamp"))
    elif isinstance(dtype, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col)
    else:
        micros = F.unix_micros(col.cast("timestamp"))
    return F.bround(micros / F.lit(1_000_000), 0).cast("bigint")


def cui_patient_facts(
    annotations: DataFrame,
    doc2ptt: DataFrame,
    cui_col: str = "cui",
    doc_col: str = "docid",
    ts_col: str | None = "timestamp",
    patient_col: str = "patient",
) -> DataFrame:
    """``cui, patient, n, first_seen`` of affirmed mentions in known documents.

    Mentions are reduced to one row per document and concept before the join, so
    a document (or a document-concept pair) with a large share of all mentions is
    combined on the map side and never lands in one join task.  Document ids are
    compared as text.
    """
    seconds = epoch_seconds(named(ts_col), annotations.schema[ts_col].dataType) if ts_col else F.lit(None).cast("bigint")
    mentions = annotations.select(
        named(doc_col).cast("string").alias("doc"), named(cui_col).alias("cui"), seconds.alias("s")
    )
    # 0 is the "not set" value of a mention time.
    per_doc = mentions.groupBy("doc", "cui").agg(F.count("*").alias("n"), F.min(F.nullif("s", F.lit(0))).alias("s"))
    known = doc2ptt.select(named(doc_col).cast("string").alias("doc"), named(patient_col).alias("patient"))
    return per_doc.join(known, "doc").groupBy("cui", "patient").agg(F.sum("n").alias("n"), F.min("s").alias("first_seen"))


def cui_patient_counts(annotations: DataFrame, doc2ptt: DataFrame, **names: str) -> DataFrame:
    """Mentions per concept and patient: ``cui, patient, n``."""
    return cui_patient_facts(annotations, doc2ptt, **{**names, "ts_col": None}).drop("first_seen")


def cui_patient_first_seen(annotations: DataFrame, doc2ptt: DataFrame, **names: str) -> DataFrame:
    """First mention per concept and patient in epoch seconds: ``cui, patient, first_seen``."""
    return cui_patient_facts(annotations, doc2ptt, **names).select("cui", "patient", "first_seen").filter("first_seen IS NOT NULL")


def merge_counts(dfs: Sequence[DataFrame], keys: Sequence[str] = ("cui", "patient")) -> DataFrame:
    """Merge partial results: counts add, first mention times take the minimum."""
    rows = union_all(dfs)
    aggs = []
    if "n" in rows.columns:
        aggs.append(F.sum("n").alias("n"))
    if "first_seen" in rows.columns:
        aggs.append(F.min("first_seen").alias("first_seen"))
    return rows.groupBy(*keys).agg(*aggs)


def to_nested_map(
    df: DataFrame, outer: str, inner: str, value: str, max_entries: int | None = None
) -> DataFrame:
    """``{outer: {inner: value}}`` as rows ``outer, part, entries``: one row, part 0, per outer key.

    A map has to fit a cell: a key with more than ``MAP_ENTRIES`` inner keys ends the
    job with an error that names it.  ``max_entries`` asks for another format, in which
    an outer key with more inner keys than that is spread over several parts by a hash of
    the inner key, so that no task holds the map of a hot key whole.  The parts of a key
    have no inner key in common: their union is the full map.  ``df`` is read twice;
    pass a stored table when it is costly.
    """
    n = F.count("*")
    if max_entries is None:
        said = F.concat(named(outer).cast("string"), F.lit(": "), F.col("_n").cast("string"), F.lit(" entries do not fit one map; ask for parts"))
        counted = df.groupBy(named(outer).alias(outer)).agg(n.alias("_n"))
        fits = F.when(F.col("_n") > MAP_ENTRIES, F.raise_error(said).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
        sizes = counted.select(named(outer), fits.alias("_parts"))
    else:
        sizes = df.groupBy(named(outer).alias(outer)).agg(F.ceil(n / max_entries).cast("bigint").alias("_parts"))
    # Size rows are one per outer key; Spark broadcasts them when they measure small.
    spread = df.join(sizes, outer).withColumn("part", part_of(named(inner), F.col("_parts")))
    entry = F.struct(named(inner).cast("string").alias("key"), named(value).alias("value"))
    # Stated, because the join leaves rows partitioned by the outer key alone, which
    # the grouping would accept: all parts of a hot key would share one task.
    spread = spread.repartition(named(outer), F.col("part"))
    return spread.groupBy(named(outer).alias(outer), "part").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("entries"))


@dataclass(frozen=True)
class PatientColumns:
    """Where the patient record keeps what; a column may be absent from the input."""

    patient: str = "patient"
    ethnicity: str = "ethnicity"
    gender: str = "gender"
    birth: str = "birthdate"
    death: str = "deathdate"
    death_backup: str = ""
    document: str = "docid"
    ordinal: str = "ordinal"
    date_format: str = "yyyy-MM-dd"


def _date(df: DataFrame, name: str, fmt: str, epoch_default: bool) -> tuple[Column, Column]:
    """(parsed date, given but not readable) for a column that may be absent."""
    if name not in df.columns:
        absent = parse_date(F.lit(None).cast("string"), epoch_default=epoch_default)
        return absent, F.lit(False)
    dtype, col = df.schema[name].dataType, named(name)
    if isinstance(dtype, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        return col.cast("timestamp_ntz"), F.lit(False)
    parsed = parse_date(col, fmt, epoch_millis=isinstance(dtype, T.IntegralType), epoch_default=epoch_default)
    return parsed, is_bad_date(col, parsed)


def death_column(df: DataFrame, cols: PatientColumns, when: str = "absent") -> str | Column:
    """The death date source: the backup serves when the main column is absent.

    With ``when='null'`` the backup also fills nulls of the main column.
    """
    if cols.death not in df.columns:
        return cols.death_backup or cols.death
    if when == "null" and cols.death_backup in df.columns:
        return F.coalesce(named(cols.death), named(cols.death_backup))
    return cols.death


def patient_table(
    records: DataFrame,
    as_of: Column,
    cols: PatientColumns = PatientColumns(),
    ethnicity_map: DataFrame | None = None,
    age_limit: bool = False,
    epoch_default: bool = False,
    death_when: str = "absent",
    signed_age: bool = False,
) -> DataFrame:
    """One row per patient: ``patient, sex, ethnicity, dob, dod, age, has_dates``.

    The last record (highest ordinal) of a patient gives sex and ethnicity; the
    last one whose dates can be read gives the dates and the age.  Records without a
    patient are ``nameless_patients``.  One shuffle on the patient, combined on the map side.  ``ethnicity_map`` has columns
    ``code, label``.
    """
    rows = _patient_rows(records, cols, epoch_default, death_when)
    age, dod = age_and_death(F.col("dob"), F.col("dod"), as_of, age_limit, signed_age)
    rows = rows.select(
        "patient", "ethnicity", "sex", "bad", "ordinal",
        ts_to_int(F.col("dob")).alias("dob"), ts_to_int(dod).alias("dod"), age.alias("age"),
    )
    # Of equal ordinals the greater values win, so that a rerun gives the same rows.
    who, dates = ("ethnicity", "sex"), ("dob", "dod", "age")
    latest = rows.groupBy("patient").agg(
        F.max_by(F.struct(*who), F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", *who))).alias("who"),
        F.max_by(F.struct(*dates), F.when(~F.col("bad") & F.col("ordinal").isNotNull(), F.struct("ordinal", *dates))).alias("dates"),
    )
    flat = latest.select(
        "patient", "who.sex", "who.ethnicity", "dates.dob", "dates.dod", "dates.age", F.col("dates").isNotNull().alias("has_dates")
    )
    if ethnicity_map is not None:
        flat = map_codes(flat, "ethnicity", ethnicity_map)
    return flat.withColumn("ethnicity", title_case(F.col("ethnicity")))


def _patient_rows(records: DataFrame, cols: PatientColumns, epoch_default: bool, death_when: str) -> DataFrame:
    """Cleaned records.  Dates are parsed in this projection, once, and used in the next."""
    death = death_column(records, cols, death_when)
    if not isinstance(death, str):
        records, death = records.withColumn("_death", death), "_death"
    dob, bad_dob = _date(records, cols.birth, cols.date_format, epoch_default)
    dod, bad_dod = _date(records, death, cols.date_format, False)
    has = records.columns
    return records.filter(named(cols.patient).isNotNull()).select(
        clean_id(named(cols.patient)).alias("patient"),
        (norm_label(named(cols.ethnicity)) if cols.ethnicity in has else F.lit("other")).alias("ethnicity"),
        (norm_gender(named(cols.gender)) if cols.gender in has else F.lit("Unknown")).alias("sex"),
        dob.alias("dob"),
        dod.alias("dod"),
        (bad_dob | bad_dod).alias("bad"),
        (named(cols.document) if cols.document in has else F.lit(None)).cast("string").alias("docid"),
        named(cols.ordinal).alias("ordinal"),
    )


def doc_to_patient(records: DataFrame, cols: PatientColumns = PatientColumns()) -> DataFrame:
    """``docid, patient`` of records with readable dates; the last record of a document wins."""
    rows = _patient_rows(records, cols, False, "absent")
    usable = rows.filter(~F.col("bad") & F.col("docid").isNotNull())
    return usable.groupBy("docid").agg(F.max_by("patient", F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "patient"))).alias("patient"))


def nameless_patients(records: DataFrame, cols: PatientColumns = PatientColumns()) -> DataFrame:
    """The records that no table has, because they name no patient, with ``error``."""
    return records.filter(named(cols.patient).isNull()).withColumn("error", F.lit("record without a patient"))


def patient_dims(
    records: DataFrame, as_of: Column, cols: PatientColumns = PatientColumns(), **options: object
) -> dict[str, DataFrame]:
    """The patient dimension as key-value frames: sex, ethnicity, dob, dod, age, doc2ptt."""
    table = patient_table(records, as_of, cols, **options)
    return dims_of(table) | {"doc2ptt": doc_to_patient(records, cols)}


def dims_of(table: DataFrame) -> dict[str, DataFrame]:
    """The dimensions of a patient table; store it first if several of them are written."""
    dated = table.filter("has_dates")
    dims = {name: table.select("patient", name) for name in ("sex", "ethnicity")}
    return dims | {name: dated.select("patient", name) for name in ("dob", "dod", "age")}
