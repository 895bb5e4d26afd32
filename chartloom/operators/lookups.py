"""Lookup joins.

No side is forced to broadcast: Spark broadcasts a lookup when its measured size
is under ``spark.sql.autoBroadcastJoinThreshold``.  Beyond it the join is a shuffled
one, where rows without a key are spread by a row hash instead of meeting in one
task, and AQE splits a partition that a hot key makes too big.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.binary import base64_text
from chartloom.functions.geo import geo_string
from chartloom.functions.names import named
from chartloom.functions.text import file_stem
from chartloom.operators.records import only, row_hash


def lookup(df: DataFrame, key: Column, table: DataFrame, table_key: str) -> DataFrame:
    """Left join to a table that is unique on ``table_key``; keys compare as text, null keys never match."""
    place = F.concat(F.lit("\x00"), row_hash(df).cast("string"))
    keyed = df.withColumn("_key", F.coalesce(key.cast("string"), place))
    side = table.filter(named(table_key).isNotNull()).withColumn(table_key, named(table_key).cast("string")).withColumnRenamed(table_key, "_key")
    return keyed.join(side, "_key", "left").drop("_key")


def add_geolocation(
    df: DataFrame,
    places: DataFrame,
    postcode_col: str = "address_postcode",
    out_col: str = "address_geolocation",
    key_col: str = "postcode_no_space",
    lat_col: str = "latitude",
    lon_col: str = "longitude",
    ordinal_col: str = "ordinal",
) -> DataFrame:
    """Add ``"<lat>,<lon>"`` by postcode, and ``geolocation_error``.

    Spaces are taken out of the postcode; the match is exact and case-sensitive.
    The last row of the lookup (highest ordinal) wins for a repeated key.  No
    postcode or no match gives null; coordinates that are not numbers give null
    and mark the row as an error.
    """
    at = F.struct(named(lat_col).alias("lat"), named(lon_col).alias("lon"))
    # Of equal ordinals the greater place wins, so that a rerun gives the same rows.
    order = F.when(named(ordinal_col).isNotNull(), F.struct(named(ordinal_col), named(lat_col), named(lon_col)))
    latest = places.groupBy(named(key_col).alias("_place")).agg(F.max_by(at, order).alias("_at"))
    table = latest.select("_place", F.lit(True).alias("_hit"), geo_string(F.col("_at.lat"), F.col("_at.lon")).alias("_geo"))
    code = F.replace(named(postcode_col).cast("string"), F.lit(" "), F.lit(""))
    key = F.when(named(postcode_col).cast("string") != "", code)
    kept = [c for c in df.columns if c != out_col]
    joined = lookup(df, key, table, "_place")
    return joined.select(
        *only(df, kept), F.col("_geo").alias(out_col), (F.col("_hit").isNotNull() & F.col("_geo").isNull()).alias("geolocation_error")
    )


def map_codes(df: DataFrame, col: str, codes: DataFrame, code_col: str = "code", label_col: str = "label") -> DataFrame:
    """Replace values by their label; a value without one stays.

    Codes of any type compare as text; where labels are of another type than the
    column, the column becomes text.
    """
    table = codes.groupBy(named(code_col).cast("string").alias("_code")).agg(F.max(named(label_col)).alias("_label"))
    if table.schema["_label"].dataType == df.schema[col].dataType:
        label, own = F.col("_label"), named(col)
    else:
        label, own = F.col("_label").cast("string"), named(col).cast("string")
    joined = lookup(df, named(col), table, "_code")
    return joined.select(
        *[(F.coalesce(label, own) if c == col else named(c)).alias(c) for c in df.columns]
    )


# The column names of the joined patient and encounter view.
PATIENT_VIEW = {
    "id": "patient_id", "birthdate": "patient_birth_date", "deathdate": "death_date", "ssn": "patient_ssn",
    "drivers": "patient_drivers", "passport": "patient_passport", "prefix": "patient_prefix",
    "first": "patient_first_name", "last": "patient_last_name", "suffix": "patient_suffix",
    "maiden": "patient_maiden", "marital": "patient_marital", "race": "patient_race",
    "ethnicity": "patient_ethnicity", "gender": "patient_gender", "birthplace": "patient_birthplace",
    "address": "patient_addr", "city": "patient_city", "state": "patient_state", "zip": "patient_zip",
}
ENCOUNTER_VIEW = {
    "id": "encounter_id", "start": "encounter_start", "stop": "encounter_stop", "code": "encounter_code",
    "description": "encounter_desc", "cost": "encounter_cost", "reasoncode": "encounter_reason_code",
    "reasondescription": "encounter_reason_desc",
}
ENTITIES = (
    "allergies", "careplans", "conditions", "imaging_studies", "immunizations", "medications", "observations", "procedures",
)


def patient_encounters(patients: DataFrame, encounters: DataFrame) -> DataFrame:
    """Patients joined to their encounters, columns renamed; absent ones are left out."""
    people = patients.select(*[named(c).alias(n) for c, n in PATIENT_VIEW.items() if c in patients.columns])
    visits = encounters.select(
        F.col("patient").alias("patient_id"),
        *[named(c).alias(n) for c, n in ENCOUNTER_VIEW.items() if c in encounters.columns],
    )
    names = [*people.columns, *[c for c in visits.columns if c != "patient_id"]]
    return people.join(visits, "patient_id").select(*names)


def entity_view(
    encounters_view: DataFrame, entity: DataFrame, pk_col: str = "cog_pk", ts_col: str = "cog_timestamp"
) -> DataFrame:
    """A clinical entity with its patient and encounter, its key and its time."""
    view = encounters_view.alias("v")
    on = (F.col("e.patient") == F.col("v.patient_id")) & (F.col("e.encounter") == F.col("v.encounter_id"))
    joined = entity.alias("e").join(view, on)
    clash = set(encounters_view.columns) & set(entity.columns)
    return joined.select(
        *[F.col(f"v.{c}") for c in encounters_view.columns],
        *[F.col(f"e.{c}").alias(f"entity_{c}" if c in clash else c) for c in entity.columns],
        F.col("e.cid").alias(pk_col),
        F.col("e.created").alias(ts_col),
    )


def entity_views(encounters_view: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The view of every entity table given, as ``<table>_view``."""
    unknown = set(tables) - set(ENTITIES)
    if unknown:
        raise ValueError(f"not an entity table: {sorted(unknown)}")
    return {f"{name}_view": entity_view(encounters_view, df) for name, df in tables.items()}


def join_metadata(
    files: DataFrame, metadata: DataFrame, id_col: str = "file_name_id_no_ext", folder_col: str = "folder"
) -> DataFrame:
    """File payloads with the metadata row of the same folder and file stem.

    ``files`` has ``folder, file_name, content``.  Metadata without a file and
    files without metadata are dropped; missing metadata values become empty.  Of
    files of a folder with the same stem the last by name counts.
    """
    last = files.groupBy(named(folder_col), file_stem(F.col("file_name")).alias(id_col)).agg(
        F.max_by("content", "file_name").alias("content")
    )
    keyed = last.select(named(folder_col), id_col, base64_text(F.col("content")).alias("binarydoc"))
    meta = metadata.withColumn(id_col, named(id_col).cast("string"))
    names = [c for c in meta.columns if c not in (folder_col, "binarydoc", "text")]
    joined = meta.join(keyed, [folder_col, id_col])
    return joined.select(folder_col, *[named(c) for c in names], "binarydoc", F.lit("").alias("text")).na.fill("")


def annotation_star(
    documents: DataFrame,
    annotations: DataFrame,
    meta_annotations: DataFrame,
    models: DataFrame,
    document_key: str = "document_id",
) -> DataFrame:
    """Documents, their annotations, the meta annotations of these and the model used.

    The keys of the schema: annotation to document by ``document_key``, to model by
    ``model_id_used``, meta annotation to annotation by ``annotation_id``.
    """
    ann = annotations.select(*[named(c).alias(c if c in (document_key, "model_id_used") else f"ann_{c}") for c in annotations.columns])
    meta = meta_annotations.select(
        F.col("annotation_id").alias("ann_id"), *[named(c).alias(f"meta_{c}") for c in meta_annotations.columns if c != "annotation_id"]
    )
    used = models.select(F.col("id").alias("model_id_used"), *[named(c).alias(f"model_{c}") for c in models.columns if c != "id"])
    docs = documents.select(*[named(c).alias(c if c == document_key else f"doc_{c}") for c in documents.columns])
    return docs.join(ann, document_key).join(meta, "ann_id").join(used, "model_id_used")
