"""Record readers."""

from __future__ import annotations

import codecs
import importlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.names import named

Schema = str | T.StructType

UNREADABLE = "_unreadable"

# The columns of the postcode lookup file, which has no header.
POSTCODE_COLUMNS: tuple[str, ...] = (
    "postcode", "status", "usertype", "easting", "northing", "positional_quality_indicator", "country", "latitude",
    "longitude", "postcode_no_space", "postcode_fixed_width_seven", "postcode_fixed_width_eight", "postcode_area",
    "postcode_district", "postcode_sector", "outcode", "incode",
)


def read_json_records(
    spark: SparkSession, path: str | Sequence[str], schema: Schema | None = None, name_glob: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Files that hold one object or an array of objects: (one row per object, unreadable files).

    A file is one parse unit, read by one task; big exports belong in NDJSON.  A file
    that is neither, or has a value that doesn't fit the schema anywhere, fails whole:
    its ``path``, ``text``, what could be read of it (``record``) and ``error``.
    ``name_glob`` picks files by name in a whole folder tree.  Pass a schema for big
    inputs: inferring one reads them all.
    """
    good, failed = _json(spark, path, schema, name_glob, multi_line=True)
    # All rows of a broken array carry its text: one is enough.
    whole = failed.groupBy("path").agg(F.first("text").alias("text"), F.max("record").alias("record"), F.first("error").alias("error"))
    return good, whole


def read_ndjson(
    spark: SparkSession, path: str | Sequence[str], schema: Schema | None = None, name_glob: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """One JSON object per line: (records, unreadable lines); blank lines are skipped.

    An unreadable line, or one with a value that doesn't fit the schema, is a row ``path,
    text, record, error``, where ``record`` has what could be read of it.
    """
    return _json(spark, path, schema, name_glob, multi_line=False)


def _json(
    spark: SparkSession, path: str | Sequence[str], schema: Schema | None, name_glob: str | None, multi_line: bool
) -> tuple[DataFrame, DataFrame]:
    reader = spark.read.option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", UNREADABLE)
    if name_glob is not None:
        reader = reader.option("pathGlobFilter", name_glob).option("recursiveFileLookup", True)
    if schema is not None:
        shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        reader = reader.schema(T.StructType([*shape.fields, T.StructField(UNREADABLE, T.StringType())]))
    rows = reader.json(path if isinstance(path, str) else list(path))
    if UNREADABLE not in rows.columns:  # inferred, and everything could be read
        rows = rows.withColumn(UNREADABLE, F.lit(None).cast("string"))
    fields = [c for c in rows.columns if c != UNREADABLE]
    read = F.to_json(F.struct(*[named(c) for c in fields])) if fields else F.lit(None).cast("string")
    # The test of what was read is always true; Spark refuses to read unreadable text and nothing else.
    failed = rows.filter(F.col(UNREADABLE).isNotNull() & read.isNotNull()).select(
        F.col("_metadata.file_path").alias("path"), F.col(UNREADABLE).alias("text"), read.alias("record"),
        F.lit("not JSON, or not of the schema").alias("error"),
    )
    return rows.filter(F.col(UNREADABLE).isNull()).drop(UNREADABLE), failed


def read_encoded_json(
    spark: SparkSession, path: str, schema: Schema, charsets: Sequence[str] = ("utf-8", "windows-1252"), name_glob: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Like ``read_json_records`` for files in any of several charsets, the first that fits each.

    A file that none of them fits, or that isn't an object or array of objects, fails.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", name_glob) if name_glob else reader).load(path)
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*shape.fields, T.StructField(UNREADABLE, T.StringType())])
    text = decode_with_fallback(F.col("content"), charsets)
    parsed = files.select("path", text.alias("text")).withColumn(
        "records", F.from_json("text", T.ArrayType(marked), {"columnNameOfCorruptRecord": UNREADABLE})
    )
    bad = F.col("records").isNull() | F.exists("records", lambda r: r.isNull() | r[UNREADABLE].isNotNull())
    error = F.when(F.col("text").isNull(), "no charset fits").otherwise("not JSON, or not of the schema")
    failed = parsed.filter(bad).select("path", "text", F.to_json("records").alias("record"), error.alias("error"))
    good = parsed.filter(~bad).select(F.explode("records").alias("r")).select("r.*").drop(UNREADABLE)
    return good, failed


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet through the vectorised reader."""
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: Schema | None = None, sep: str = "|", header: bool = True) -> DataFrame:
    """Delimited text; without a schema all columns are text."""
    reader = spark.read.option("sep", sep).option("header", header)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_postcodes(spark: SparkSession, path: str) -> DataFrame:
    """The postcode lookup file, with the file position of each row as ``ordinal``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in POSTCODE_COLUMNS])
    # Position by file and block, because splits of a file are not scheduled in order.
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return spark.read.schema(schema).csv(path).select("*", place.alias("ordinal"))


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """Avro container files; needs the spark-avro package on the class path."""
    require_avro(spark)
    return spark.read.format("avro").load(path)


def require_avro(spark: SparkSession) -> None:
    """Fail early, and say what is missing."""
    try:
        spark.read.format("avro").schema("a int").load([])
    except Exception as exc:
        raise RuntimeError("Avro needs the org.apache.spark:spark-avro package on the class path") from exc


def decode_with_fallback(col: Column, charsets: Sequence[str] = ("utf-8", "windows-1252")) -> Column:
    """Bytes as text by the first charset that fits; null when none does.

    Any charset that Python has: utf-8, us-ascii, iso-8859-1 and all single-byte ones (by
    their tables) natively; those of several bytes or with states (utf-16, gb18030,
    shift_jis, iso-2022-jp, ...) by their strict decoders on Arrow batches, for values
    that no charset before them fits.  A single-byte charset fits nearly everything, so
    put it last.
    """
    text = _decoded(col, charsets[0])
    for charset in charsets[1:]:
        text = F.coalesce(text, _decoded(F.when(text.isNull(), col), charset))
    return text


#: Stands for a byte without a character in the tables of codecs.
_NONE = "\ufffe"


def _table(charset: str) -> str | None:
    """The characters of a single-byte charset by byte; None for other kinds."""
    name = codecs.lookup(charset).name.replace("-", "_")
    try:
        module = importlib.import_module(f"encodings.{name}")
    except ImportError:
        return None
    table = getattr(module, "decoding_table", None)
    return table if isinstance(table, str) else None


def _decoded(col: Column, charset: str) -> Column:
    name = codecs.lookup(charset).name
    if name in ("utf-8", "utf-8-sig"):
        return F.when(F.is_valid_utf8(col.cast("string")), col.cast("string"))
    latin = F.decode(col, "ISO-8859-1")
    if name == "ascii":
        return F.when(~latin.rlike(r"[^\x00-\x7F]"), latin)
    if name == "iso8859-1":
        return latin
    if (table := _table(name)) is not None:
        table = table.ljust(256, _NONE)
        moved = [b for b in range(256) if table[b] not in (chr(b), _NONE)]
        unused = "".join(f"\\x{{{b:X}}}" for b in range(256) if table[b] == _NONE)
        text = F.translate(latin, "".join(map(chr, moved)), "".join(table[b] for b in moved)) if moved else latin
        return F.when(~latin.rlike(f"[{unused}]"), text) if unused else F.when(latin.isNotNull(), text)

    def strict(value: bytes | None) -> str | None:
        try:
            text = None if value is None else bytes(value).decode(name)
            return text if text is None else text.encode().decode()  # halves of pairs are no text
        except UnicodeError:
            return None

    def decode(values: pd.Series) -> pd.Series:
        return values.map(strict)

    return F.pandas_udf(decode, "string")(col)
