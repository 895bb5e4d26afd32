"""Document files in a folder tree, with or without a metadata table beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.binary import base64_text
from chartloom.functions.ids import pseudo_id
from chartloom.functions.text import file_stem
from chartloom.operators.ledger import not_yet_processed
from chartloom.operators.lookups import join_metadata
from chartloom.sources.records import Schema

# Fixed value: which folders hold documents (matched from the start of the path).
FOLDER_PATTERN = r".*\d{4}/\d{2}/\d{2}"


def list_documents(spark: SparkSession, root: str, folder_pattern: str = FOLDER_PATTERN) -> DataFrame:
    """``path, folder, file_name, length`` of document files; contents are not read.

    A file with ``csv`` anywhere in its name is metadata and no document.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _located(files.select("path", "length"), folder_pattern)


def _located(files: DataFrame, folder_pattern: str) -> DataFrame:
    path = F.regexp_replace("path", "^file:/+", "/")
    return (
        files.withColumn("file_name", F.substring_index("path", "/", -1))
        .withColumn("folder", F.regexp_replace(path, "/[^/]*$", ""))
        .filter(F.col("folder").rlike(f"^(?:{folder_pattern})"))
        .filter(~F.col("file_name").contains("csv"))
    )


def read_documents(
    spark: SparkSession,
    root: str,
    mode: str = "with_metadata",
    folder_pattern: str = FOLDER_PATTERN,
    metadata_schema: Schema | None = None,
    sep: str = "|",
    encoding: str = "UTF-8",
    id_col: str = "file_name_id_no_ext",
    pseudo: bool = False,
    ledger: DataFrame | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Documents of a tree as rows with a base64 payload.

    ``with_metadata`` joins the metadata files of the same folder (in ``encoding``) by file stem.
    ``files_only`` gives ``folder, document_Id, binarydoc, document_Fields_text``, plus
    ``document_Pseudo_Id`` on request.  ``ledger`` (``folder, document_id``) names the
    files that are done.  ``max_files`` bounds one run: the first files by path,
    picked from the listing before any content is read.
    """
    if mode not in ("with_metadata", "files_only"):
        raise ValueError(f"mode must be 'with_metadata' or 'files_only', not {mode!r}")
    if max_files is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        files = _pending(_located(files, folder_pattern), ledger)
    else:
        picked = _pending(list_documents(spark, root, folder_pattern), ledger).orderBy("path").limit(max_files)
        paths = [r.path for r in picked.select("path").collect()]  # at most max_files
        if paths:
            files = _located(spark.read.format("binaryFile").load(paths), folder_pattern)
        else:
            files = _located(spark.read.format("binaryFile").load(root), folder_pattern).filter(F.lit(False))

    if mode == "files_only":
        stem = file_stem(F.col("file_name"))
        columns = [
            F.col("folder"),
            stem.alias("document_Id"),
            base64_text(F.col("content")).alias("binarydoc"),
            F.lit("").alias("document_Fields_text"),
        ]
        if pseudo:
            columns.append(pseudo_id(F.concat_ws("/", "folder", stem)).alias("document_Pseudo_Id"))
        return files.select(*columns)

    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*csv*").option("sep", sep).option("header", True).option("encoding", encoding)
    metadata = (reader.schema(metadata_schema) if metadata_schema is not None else reader).csv(root)
    # This path is URL-encoded (but for a plus), the one of the documents is plain.
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(F.regexp_replace(plain, "^file:/+", "/"), "/[^/]*$", "")
    metadata = metadata.select("*", folder.alias("folder"))
    return join_metadata(files, metadata, id_col)


def _pending(files: DataFrame, ledger: DataFrame | None) -> DataFrame:
    if ledger is None:
        return files
    done = ledger.select(F.concat_ws("/", "folder", F.col("document_id").cast("string")).alias("document_id"))
    return not_yet_processed(files, done, F.concat_ws("/", "folder", file_stem(F.col("file_name"))))
