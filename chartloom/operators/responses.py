"""Service responses as tables: one row per document or per annotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.ids import annotation_id
from chartloom.functions.names import named
from chartloom.functions.text import is_blank
from chartloom.operators.records import only

RESTORE, DROP = "restore", "drop"
EMPTY_TEXT_STATUS, NO_ANNOTATIONS_STATUS = "skipped_empty_text", "no_annotations"


def _fields(dtype: T.DataType | None) -> list[str]:
    return dtype.names if isinstance(dtype, T.StructType) else []


def _field(struct: Column, dtype: T.DataType, name: str, default: str | None = None) -> Column:
    """A field, or a typed null / default where the schema lacks it."""
    value = struct[name] if name in _fields(dtype) else F.lit(None).cast(default or "string")
    return value


def _empty_object(dtype: T.DataType | None) -> Column:
    """``{}`` in the type at hand."""
    if isinstance(dtype, (T.StructType, T.MapType)):
        return F.from_json(F.lit("{}"), dtype)
    return F.create_map().cast("map<string,string>")


def _over(out: dict[str, Column], types: dict[str, T.DataType], name: str, value: Column, dtype: T.DataType) -> Column:
    """A footer value over an earlier one of the same name, which shows where the footer has none.

    Records of one frame share their columns, so a footer without the key and one with a
    null look alike; either leaves the earlier value.  Unlike types meet as text.
    """
    if name not in out:
        types[name] = dtype
        return value
    if types.get(name) == dtype:
        return F.coalesce(value, out[name])
    types[name] = T.StringType()
    return F.coalesce(value.cast("string"), out[name].cast("string"))


def parse_ocr(df: DataFrame, text_col: str = "text", result_col: str = "result") -> DataFrame:
    """One row per extraction response; footer values win over same names."""
    result_type = df.schema[result_col].dataType
    result = named(result_col)
    names = _fields(result_type)
    types = {f.name: f.dataType for f in result_type.fields}
    out: dict[str, Column] = {}
    if "metadata" in names:
        out["metadata"] = F.coalesce(result["metadata"], _empty_object(types["metadata"])) if isinstance(
            types["metadata"], (T.StructType, T.MapType)) else result["metadata"]
    else:
        out["metadata"] = _empty_object(None)
    out[text_col] = F.coalesce(_field(result, result_type, "text"), F.lit(""))
    out["success"] = F.coalesce(_field(result, result_type, "success", "boolean"), F.lit(False))
    out["timestamp"] = _field(result, result_type, "timestamp")
    known = {text_col: types.get("text", T.StringType()), "success": T.BooleanType(), "timestamp": types.get("timestamp", T.StringType())}
    known["metadata"] = types.get("metadata", T.MapType(T.StringType(), T.StringType()))
    for f in types["footer"].fields if "footer" in types else []:
        out[f.name] = _over(out, known, f.name, result["footer"][f.name], f.dataType)
    return df.select(*[c.alias(n) for n, c in out.items()])


def _documents(df: DataFrame, result_col: str, info_col: str | None) -> DataFrame:
    """Explode the results of each response: columns ``doc`` and ``info``."""
    info = named(info_col) if info_col else F.lit(None).cast("string")
    if isinstance(df.schema[result_col].dataType, T.ArrayType):
        return df.select(info.alias("info"), F.explode(named(result_col)).alias("doc"))
    return df.filter(named(result_col).isNotNull()).select(info.alias("info"), named(result_col).alias("doc"))


def _annotation_map(doc: Column, doc_type: T.StructType) -> Column:
    """The first element of ``annotations`` (a map by annotation id)."""
    return F.get(doc["annotations"], F.lit(0)) if isinstance(doc_type["annotations"].dataType, T.ArrayType) else doc["annotations"]


def parse_nlp(df: DataFrame, id_col: str = "_id", result_col: str = "result", info_col: str | None = "model_info") -> DataFrame:
    """One row per annotation: service, time, annotation fields, footer fields.

    A later group wins where names meet and it has a value.  ``annotation_id`` is added when the
    footer has ``id_col``.  Documents without annotations give no rows.
    """
    docs = _documents(df, result_col, info_col)
    doc, doc_type = F.col("doc"), docs.schema["doc"].dataType
    # Prune before the explode, which repeats what is left for every annotation.
    footer_type = doc_type["footer"].dataType if "footer" in _fields(doc_type) else None
    slim = docs.select(
        "info",
        _field(doc, doc_type, "timestamp").alias("ts"),
        (doc["footer"] if footer_type else F.lit(None)).alias("footer"),
        F.explode(_annotation_map(doc, doc_type)).alias("ann_id", "ann"),
    )
    out: dict[str, Column] = {"service_model": F.col("info"), "timestamp": F.col("ts")}
    known = {"service_model": slim.schema["info"].dataType, "timestamp": slim.schema["ts"].dataType}
    for group, kind in (("ann", slim.schema["ann"].dataType), ("footer", footer_type)):
        for f in kind.fields if isinstance(kind, T.StructType) else []:
            out[f.name] = _over(out, known, f.name, F.col(group)[f.name], f.dataType)
    if id_col in _fields(footer_type):
        out["annotation_id"] = annotation_id(F.col("footer")[id_col], F.col("ann_id"))
    return slim.select(*[c.alias(n) for n, c in out.items()])


def parse_deid(
    df: DataFrame,
    text_col: str = "text",
    document_text_col: str = "text",
    keep_annotations: bool = True,
    empty_text: str = DROP,
    no_annotations: str = RESTORE,
    result_col: str = "result",
    info_col: str | None = "model_info",
    status_col: str = "service_status",
) -> DataFrame:
    """One row per de-identified document.

    Checked in this order: a successful result with blank text (there, but without a
    character; a result without any text is no such one) follows
    ``empty_text``; a result without annotations is restored when it was
    successful and ``no_annotations`` says so, else dropped; anything else is
    emitted.  A restored row is the footer, the text in ``document_text_col`` and
    a status; in other rows footer values win over same names, where the footer has one.

    **A footer that carries the raw text under the name of ``text_col`` puts it in the
    place of the de-identified one.**  That is the service's contract; give ``text_col``
    another name where it must not be.
    """
    for name, value in (("empty_text", empty_text), ("no_annotations", no_annotations)):
        if value not in (DROP, RESTORE):
            raise ValueError(f"{name} must be 'drop' or 'restore', not {value!r}")
    docs = _documents(df, result_col, info_col)
    doc, doc_type = F.col("doc"), docs.schema["doc"].dataType
    success = F.coalesce(_field(doc, doc_type, "success", "boolean"), F.lit(False))
    text = _field(doc, doc_type, "text")
    annotations = _annotation_map(doc, doc_type)
    bare = F.coalesce(F.size(annotations), F.lit(0)) <= 0
    status = (
        F.when(success & text.isNotNull() & is_blank(text), F.lit(EMPTY_TEXT_STATUS if empty_text == RESTORE else DROP))
        .when(bare & success, F.lit(NO_ANNOTATIONS_STATUS if no_annotations == RESTORE else DROP))
        .when(bare, F.lit(DROP))
    )
    kept = docs.withColumn("status", status).filter(F.col("status").isNull() | (F.col("status") != DROP))

    restored = F.col("status").isNotNull()
    footer_type = doc_type["footer"].dataType if "footer" in _fields(doc_type) else None
    shown = annotations if keep_annotations else F.map_filter(annotations, lambda k, v: F.lit(False))
    plain_text = F.coalesce(text, F.lit(""))
    out: dict[str, Column] = {
        "service_model": F.when(~restored, F.col("info")),
        "timestamp": F.when(~restored, _field(doc, doc_type, "timestamp")),
        text_col: F.when(~restored, plain_text),
        "annotations": F.when(~restored, shown),
    }
    known = {"service_model": kept.schema["info"].dataType, "annotations": kept.select(shown.alias("a")).schema["a"].dataType}
    types = {f.name: f.dataType for f in doc_type.fields}
    known |= {"timestamp": types.get("timestamp", T.StringType()), text_col: types.get("text", T.StringType())}
    for f in footer_type.fields if isinstance(footer_type, T.StructType) else []:
        out[f.name] = _over(out, known, f.name, doc["footer"][f.name], f.dataType)
    own = out.get(document_text_col, F.lit(None).cast("string"))
    out[document_text_col] = F.when(restored, plain_text).otherwise(own)
    out[status_col] = F.col("status")
    return kept.select(*[c.alias(n) for n, c in out.items()])


def flatten_annotations(
    df: DataFrame,
    kind: str = "keyed",
    id_col: str = "_id",
    include_footer: Sequence[str] = (),
    ann_id_field: str = "id",
    ignore_types: Sequence[str] = (),
    types_field: str = "types",
    result_col: str = "result",
    info_col: str = "model_info",
) -> DataFrame:
    """One prefixed row per annotation.

    Annotation fields become ``nlp.<name>``, the named footer fields
    ``meta.<name>``, with ``service_model``, ``service_version``, ``timestamp`` and
    ``meta.<id_col>``.  ``keyed`` responses hold a map by annotation id, a document
    id in the footer and their own time; ``listed`` ones hold a list, and take the
    id and the processing time from ``record_metadata``.  An annotation with any
    type of ``ignore_types`` is left out.  Documents without an id give no rows here;
    ``unidentified_documents`` has them.
    """
    if kind not in ("keyed", "listed"):
        raise ValueError(f"kind must be 'keyed' or 'listed', not {kind!r}")
    docs = _documents(df, result_col, info_col)
    doc, doc_type = F.col("doc"), docs.schema["doc"].dataType
    footer_names = _fields(doc_type["footer"].dataType) if "footer" in _fields(doc_type) else []
    document = _document_id(doc, kind, id_col)
    stamp = doc["timestamp"] if kind == "keyed" else doc["record_metadata"]["nlp_processing_date"]
    is_map = isinstance(doc_type["annotations"].dataType, T.MapType)
    exploded = (F.explode if is_map else F.posexplode)(doc["annotations"]).alias("ann_id", "ann")
    extra = [f for f in include_footer if f in footer_names]
    rows = docs.filter(document.isNotNull()).select(
        F.col("info")["service_model"].alias("service_model"),
        F.col("info")["service_version"].alias("service_version"),
        stamp.alias("timestamp"),
        document.alias("document"),
        *[doc["footer"][f].alias(f"footer_{i}") for i, f in enumerate(extra)],
        exploded,
    )
    if ignore_types:
        hit = F.arrays_overlap(F.col("ann")[types_field], F.array(*[F.lit(t) for t in ignore_types]))
        rows = rows.filter(~F.coalesce(hit, F.lit(False)))
    out: dict[str, Column] = {f"nlp.{n}": F.col("ann")[n] for n in _fields(rows.schema["ann"].dataType)}
    out |= {n: F.col(n) for n in ("service_model", "service_version", "timestamp")}
    out[f"meta.{id_col}"] = F.col("document")
    out |= {f"meta.{f}": F.col(f"footer_{i}") for i, f in enumerate(extra)}
    last = F.col("ann")[ann_id_field] if kind == "keyed" else F.col("ann_id")
    out["document_annotation_id"] = annotation_id(F.col("document"), last)
    return rows.select(*[c.alias(n) for n, c in out.items()])


def _document_id(doc: Column, kind: str, id_col: str) -> Column:
    return doc["footer"][id_col] if kind == "keyed" else doc["record_metadata"]["id"]


def unidentified_documents(df: DataFrame, kind: str = "keyed", id_col: str = "_id", result_col: str = "result", info_col: str = "model_info") -> DataFrame:
    """The documents whose annotations ``flatten_annotations`` can't name: ``doc``, ``info``, ``error``."""
    docs = _documents(df, result_col, info_col)
    missing = _document_id(F.col("doc"), kind, id_col).isNull()
    return docs.filter(missing).select("doc", "info", F.lit("annotated document without an id").alias("error"))


def merge_ocr(source: DataFrame, ocr: DataFrame, key: str, result_col: str = "result", ocr_key: Column | None = None) -> DataFrame:
    """Source columns plus ``text``, ``ocr_metadata`` and ``ocr_timestamp``.

    An inner join: a source row without an answer isn't in the result, one with several is there for each.
    """
    result = named(result_col)
    answers = ocr.select(
        (ocr_key if ocr_key is not None else named(key)).alias(key),
        result["text"].alias("text"),
        result["metadata"].alias("ocr_metadata"),
        result["timestamp"].alias("ocr_timestamp"),
    )
    kept = [c for c in source.columns if c not in ("text", "ocr_metadata", "ocr_timestamp")]
    return source.select(*only(source, kept)).join(answers, key, "inner")
