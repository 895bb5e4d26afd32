"""DataFrame to DataFrame operators."""

from chartloom.operators.aggregates import bucket_ledger, ids_csv, json_records, terms, with_metrics
from chartloom.operators.blobs import (
    assemble_blobs,
    assemble_documents,
    encode_payload,
    resolve_documents,
    resolve_payload,
)
from chartloom.operators.casts import cast_common, cast_dates_by_name, with_keyword
from chartloom.operators.cohort import (
    PatientColumns,
    affirmed,
    cui_patient_counts,
    cui_patient_facts,
    cui_patient_first_seen,
    dims_of,
    doc_to_patient,
    merge_counts,
    nameless_patients,
    patient_dims,
    patient_table,
    split_affirmed,
    to_nested_map,
)
from chartloom.operators.enrich import apply_text_model, assign_location, enrich
from chartloom.operators.ledger import (
    fetch_by_ids,
    incremental,
    ingest_counts,
    latest_by_key,
    ledger_rows,
    limit_batch,
    not_yet_processed,
    upsert,
)
from chartloom.operators.lookups import (
    add_geolocation,
    annotation_star,
    entity_view,
    entity_views,
    join_metadata,
    lookup,
    map_codes,
    patient_encounters,
)
from chartloom.operators.mapping import map_schema, render_items
from chartloom.operators.open_responses import deid_records, has_field, nlp_records, ocr_records, open_fields, read_open_records
from chartloom.operators.records import explode_records, json_safe, to_ndjson, union_all, with_ordinal
from chartloom.operators.requests import (
    binary_to_base64,
    extract_payload,
    hits_to_request,
    request_batches,
    split_valid,
    to_attributes,
    to_nlp_request,
    to_ocr_request,
    unwrap_hit,
)
from chartloom.operators.responses import (
    flatten_annotations,
    merge_ocr,
    parse_deid,
    parse_nlp,
    parse_ocr,
    unidentified_documents,
)
from chartloom.operators.textindex import match_indexed, search_index, write_text_index
from chartloom.operators.textops import match_text, scrub_text

__all__ = [
    "PatientColumns", "add_geolocation", "affirmed", "annotation_star", "apply_text_model", "assemble_blobs", "assemble_documents",
    "assign_location", "binary_to_base64", "bucket_ledger", "cast_common", "cast_dates_by_name",
    "cui_patient_counts", "cui_patient_facts", "cui_patient_first_seen", "deid_records", "dims_of", "doc_to_patient", "encode_payload",
    "enrich", "entity_view", "entity_views", "explode_records", "extract_payload", "fetch_by_ids",
    "flatten_annotations", "has_field", "hits_to_request", "ids_csv", "incremental", "ingest_counts", "join_metadata",
    "json_records", "json_safe", "latest_by_key", "ledger_rows", "limit_batch", "lookup", "map_codes", "map_schema",
    "match_indexed", "match_text", "merge_counts", "merge_ocr", "nameless_patients", "nlp_records", "not_yet_processed", "ocr_records", "open_fields", "parse_deid", "parse_nlp", "parse_ocr",
    "patient_dims", "patient_encounters", "patient_table", "read_open_records", "render_items", "request_batches",
    "resolve_documents", "resolve_payload", "scrub_text", "search_index", "split_affirmed", "split_valid", "terms", "to_attributes",
    "to_ndjson", "to_nested_map", "to_nlp_request", "to_ocr_request", "unidentified_documents", "union_all", "unwrap_hit", "upsert",
    "with_keyword", "with_metrics", "with_ordinal", "write_text_index",
]
