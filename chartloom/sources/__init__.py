"""Readers and writers."""

from chartloom.sources.files import list_documents, read_documents
from chartloom.sources.json_ranges import read_json_ranges
from chartloom.sources.keyed import (
    create_keyed,
    file_marks,
    latest_version,
    merge_files,
    merged_partials,
    read_keyed,
    replace_keyed,
    upsert_keyed,
)
from chartloom.sources.marks import MarkLog, run_batches, versioned_parquet
from chartloom.sources.records import (
    POSTCODE_COLUMNS,
    decode_with_fallback,
    read_avro,
    read_csv,
    read_encoded_json,
    read_json_records,
    read_ndjson,
    read_parquet,
    read_postcodes,
)
from chartloom.sources.sinks import (
    dict_json,
    dict_jsonl,
    write_avro,
    write_dict_json,
    write_dict_jsonl,
    write_failures,
    write_ndjson,
    write_split,
    write_upsert,
)
from chartloom.sources.tables import read_high_water, read_table, write_high_water

__all__ = [
    "MarkLog", "POSTCODE_COLUMNS", "create_keyed", "decode_with_fallback", "dict_json", "dict_jsonl", "file_marks",
    "latest_version", "list_documents", "merge_files", "merged_partials", "read_avro", "read_csv", "read_documents",
    "read_encoded_json", "read_high_water", "read_json_ranges", "read_json_records", "read_keyed", "read_ndjson",
    "read_parquet", "read_postcodes", "read_table", "replace_keyed", "run_batches", "upsert_keyed", "versioned_parquet",
    "write_avro", "write_dict_json", "write_dict_jsonl", "write_failures", "write_high_water", "write_ndjson", "write_split",
    "write_upsert",
]
