"""Service responses whose keys aren't known: VARIANT in, VARIANT out.

In a column of structs all records share their fields, so that a key which a footer
lacks and one that it holds as null look alike.  Here each response stays the object it
is: a key that is there wins, null or not, and a key nobody has heard of comes through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.names import named
from chartloom.functions.text import is_blank
from chartloom.operators.responses import DROP, EMPTY_TEXT_STATUS, NO_ANNOTATIONS_STATUS, RESTORE

OBJECT, LIST = "map<string,variant>", "array<variant>"


def read_open_records(spark: SparkSession, path: str, name_glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One JSON value a line: (``record``, a VARIANT; unreadable lines as ``path``, ``text``, ``error``).

    Blank lines are skipped.  A line with a list gives one record for each of its values.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", name_glob) if name_glob else reader).text(path)
    read = lines.filter(~is_blank(F.col("value"))).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.try_parse_json("value").alias("v")
    )
    failed = read.filter("v IS NULL").select("path", "text", F.lit("not JSON").alias("error"))
    listed = F.coalesce(_as(F.col("v"), LIST), F.array("v"))
    return read.filter("v IS NOT NULL").select(F.explode(listed).alias("record")), failed


def open_fields(df: DataFrame, fields: Mapping[str, str], col: str = "record") -> DataFrame:
    """Columns of the given types from the records' fields; null where a record lacks the key or its value doesn't fit."""
    return df.select(*[_at(named(col), name, kind).alias(name) for name, kind in fields.items()])


def has_field(record: Column, name: str) -> Column:
    """Whether a record has the key, be its value null."""
    return _at(record, name, "variant").isNotNull()


def _path(name: str) -> str:
    quote = '"' if "'" in name else "'"
    return f"$[{quote}{name}{quote}]"


def _at(value: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(value, _path(name), kind)


def _as(value: Column, kind: str) -> Column:
    """The value as a map or list of values; null where it is of another kind."""
    return F.try_variant_get(value, "$", kind)


def _variant(text: str) -> Column:
    return F.parse_json(F.lit(text))


def _or(value: Column, default: Column) -> Column:
    """The default where the key isn't there; null values are values."""
    return F.coalesce(value, default)


def _merged(*groups: Column) -> Column:
    """One object of several maps; where keys meet the later group's value stands, null or not."""
    out = groups[0]
    for later in groups[1:]:
        out = F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(later, k)), later)
    return out


def _map(fields: Mapping[str, Column]) -> Column:
    return F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def _nothing() -> Column:
    return F.map_filter(F.create_map(F.lit(""), _variant("null")), lambda k, v: F.lit(False))


def _split(rows: DataFrame, record: Column) -> tuple[DataFrame, DataFrame]:
    """(merged records, responses with an error); ``rows`` has ``response`` and ``error``."""
    good = rows.filter("error IS NULL").select(F.to_variant_object(record).alias("record"))
    return good, rows.filter("error IS NOT NULL").select(F.col("response").alias("record"), "error")


def _is_null(value: Column) -> Column:
    return F.is_variant_null(F.coalesce(value, _variant("0")))


def ocr_records(df: DataFrame, text_col: str = "text", col: str = "record") -> tuple[DataFrame, DataFrame]:
    """(one ``record`` for each extraction response, responses that aren't any, with ``error``).

    A record has ``metadata``, the text, ``success`` and ``timestamp``, with defaults
    ({}, "", false, null) for keys the result lacks, and the footer's keys over them.  A
    response without a result counts as an empty one; a result or a footer that is there
    but no object is an error.
    """
    rows = df.select(named(col).alias("response"), _or(_at(named(col), "result", "variant"), _variant("{}")).alias("result"))
    result = F.col("result")
    rows = rows.withColumn("footer", _or(_at(result, "footer", "variant"), _variant("{}")))
    error = F.when(_as(result, OBJECT).isNull(), "the result is no object").when(_as(F.col("footer"), OBJECT).isNull(), "the footer is no object")
    service = {
        "metadata": _or(_at(result, "metadata", "variant"), _variant("{}")),
        text_col: _or(_at(result, "text", "variant"), _variant('""')),
        "success": _or(_at(result, "success", "variant"), _variant("false")),
        "timestamp": _or(_at(result, "timestamp", "variant"), _variant("null")),
    }
    return _split(rows.withColumn("error", error), _merged(_map(service), _as(F.col("footer"), OBJECT)))


def _documents(df: DataFrame, col: str, info: str) -> DataFrame:
    """``response`` (a document of a result), ``info``, ``annotations``, ``footer`` as it is, and ``error``."""
    record = named(col)
    result = _at(record, "result", "variant")
    listed = F.coalesce(_as(result, LIST), F.array(result))
    rows = df.select(record.alias("whole"), _or(_at(record, info, "variant"), _variant("{}")).alias("info"), F.explode(F.when(result.isNotNull(), listed)).alias("response"))
    doc = F.col("response")
    held = _at(doc, "annotations", "variant")
    first = F.coalesce(F.get(_as(held, LIST), F.lit(0)), held)
    rows = rows.select("response", "info", _at(doc, "footer", "variant").alias("footer"), first.alias("held"))
    empty = F.col("held").isNull() | _is_null(F.col("held")) | (F.size(F.coalesce(_as(F.col("held"), LIST), F.array(_variant("0")))) == 0)
    marks = F.when(empty, _nothing()).otherwise(_as(F.col("held"), OBJECT))
    error = F.when(_as(doc, OBJECT).isNull(), "the document is no object").when(marks.isNull(), "the annotations are no object")
    return rows.withColumn("annotations", marks).withColumn("error", error).drop("held")


def nlp_records(df: DataFrame, id_col: str = "_id", info: str = "model_info", col: str = "record") -> tuple[DataFrame, DataFrame]:
    """(one ``record`` for each annotation, documents that aren't any, with ``error``).

    A record has ``service_model``, ``timestamp``, the annotation's keys and the footer's,
    the later over the earlier; and ``annotation_id`` if the footer has ``id_col`` with a
    value.  A response without a result and a document without annotations give none.
    An annotation or, beside annotations, a footer that is no object is an error.
    """
    docs = _documents(df, col, info)
    footer = F.when(F.col("footer").isNull(), _nothing()).otherwise(_as(F.col("footer"), OBJECT))
    docs = docs.withColumn("keys", footer)
    some = F.size("annotations") > 0
    error = F.coalesce(
        F.col("error"),
        F.when(some & F.col("keys").isNull(), "the footer is no object"),
        F.when(F.exists(F.map_values("annotations"), lambda a: _as(a, OBJECT).isNull()), "an annotation is no object"),
    )
    docs = docs.withColumn("error", error)
    broken = docs.filter("error IS NOT NULL").select(F.col("response").alias("record"), "error")
    stamp = _or(_at(F.col("response"), "timestamp", "variant"), _variant("null"))
    rows = docs.filter(F.col("error").isNull()).select("info", stamp.alias("stamp"), "keys", F.explode("annotations").alias("name", "mark"))
    service = _map({"service_model": F.col("info"), "timestamp": F.col("stamp")})
    document = F.try_variant_get(F.col("keys")[id_col], "$", "string")
    named_by = F.when(
        F.map_contains_key("keys", id_col) & document.isNotNull(),
        _map({"annotation_id": F.concat(document, F.lit("_"), F.col("name")).cast("variant")}),
    ).otherwise(_nothing())
    merged = _merged(service, _as(F.col("mark"), OBJECT), F.col("keys"), named_by)
    return rows.select(F.to_variant_object(merged).alias("record")), broken


def deid_records(
    df: DataFrame,
    text_col: str = "text",
    document_text_col: str = "text",
    keep_annotations: bool = True,
    empty_text: str = DROP,
    no_annotations: str = RESTORE,
    info: str = "model_info",
    status_col: str = "service_status",
    col: str = "record",
) -> tuple[DataFrame, DataFrame]:
    """(one ``record`` for each de-identified document, documents that aren't any, with ``error``).

    In this order: a successful result whose text is there but null or blank follows
    ``empty_text``; one without annotations is restored if it was successful, has a text
    and ``no_annotations`` says so, else dropped; all others are emitted.  A restored
    record is the footer (of another kind than an object: under ``footer``) with the text
    in ``document_text_col`` and a status.  An emitted one has ``service_model``,
    ``timestamp``, the text and the annotations, and **the footer's keys over them**: a
    footer that carries the raw text under the name of ``text_col`` puts it in the place
    of the de-identified one, as the service's contract says.  Give the two other names
    where that must not be.
    """
    for name, value in (("empty_text", empty_text), ("no_annotations", no_annotations)):
        if value not in (DROP, RESTORE):
            raise ValueError(f"{name} must be 'drop' or 'restore', not {value!r}")
    docs = _documents(df, col, info)
    doc, footer = F.col("response"), F.col("footer")
    success = F.coalesce(_at(doc, "success", "boolean"), F.lit(False)) & (F.schema_of_variant(_at(doc, "success", "variant")) == "BOOLEAN")
    success = F.coalesce(success, F.lit(False))
    text = _at(doc, "text", "variant")
    words = F.when(F.schema_of_variant(text) == "STRING", F.try_variant_get(text, "$", "string"))
    blank = text.isNotNull() & (_is_null(text) | F.coalesce(is_blank(words) & words.isNotNull(), F.lit(False)))
    bare = F.size("annotations") == 0
    fate = (
        F.when(F.col("error").isNotNull(), "error")
        .when(success & blank, EMPTY_TEXT_STATUS if empty_text == RESTORE else DROP)
        .when(bare & success & text.isNotNull(), NO_ANNOTATIONS_STATUS if no_annotations == RESTORE else DROP)
        .when(bare, DROP)
        .otherwise("whole")
    )
    rows = docs.withColumn("fate", fate).filter(F.col("fate") != DROP)
    keys = F.when(footer.isNull(), _nothing()).otherwise(_as(footer, OBJECT))
    rows = rows.withColumn("error", F.coalesce("error", F.when((F.col("fate") == "whole") & keys.isNull(), "the footer is no object")))
    service = _map({
        "service_model": F.col("info"),
        "timestamp": _or(_at(doc, "timestamp", "variant"), _variant("null")),
        text_col: _or(text, _variant('""')),
        "annotations": F.to_variant_object(F.col("annotations")) if keep_annotations else _variant("{}"),
    })
    own = F.when(_is_null(footer), _nothing()).otherwise(F.coalesce(keys, _map({"footer": footer})))
    status = _map({document_text_col: _or(text, _variant('""')), status_col: F.col("fate").cast("variant")})
    record = F.when(F.col("fate") == "whole", _merged(service, keys)).otherwise(_merged(own, status))
    return _split(rows, record)
