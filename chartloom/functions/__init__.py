"""Column functions: all native expressions, no Python workers."""

from chartloom.functions.binary import (
    base64_text,
    bytes_between,
    decode_base64,
    extract_pdf,
    extract_rtf,
    head_hex,
    is_strict_base64,
    strip_markers,
)
from chartloom.functions.dates import age_and_death, iso_text, parse_date, parse_first, ts_to_int
from chartloom.functions.geo import geo_string, wkt_point
from chartloom.functions.ids import annotation_id, clean_id, is_numeric_id, pseudo_id
from chartloom.functions.jsonsafe import json_safe_column, scalar_text
from chartloom.functions.labels import norm_gender, norm_label, title_case
from chartloom.functions.text import (
    CLINICAL_SCRUB_RULES,
    file_stem,
    has_term,
    is_blank,
    python_float_text,
    scrub,
    strip_space,
)

__all__ = [
    "CLINICAL_SCRUB_RULES", "age_and_death", "annotation_id", "base64_text", "bytes_between",
    "clean_id", "decode_base64", "extract_pdf", "extract_rtf", "file_stem", "geo_string",
    "has_term", "head_hex", "is_blank", "is_numeric_id", "is_strict_base64", "iso_text",
    "json_safe_column", "norm_gender", "norm_label", "parse_date", "parse_first", "pseudo_id",
    "python_float_text", "scalar_text", "scrub", "strip_markers", "strip_space", "title_case",
    "ts_to_int", "wkt_point",
]
