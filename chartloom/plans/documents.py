"""Document work flow: ready-made steps, and fetch -> request -> service -> table."""

from __future__ import annotations

from collections.abc import Callable
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators.blobs import FAIL, KEEP_FIRST, KEEP_LAST, assemble_documents, resolve_documents
from chartloom.operators.enrich import ServiceCall, enrich
from chartloom.operators.ledger import not_yet_processed
from chartloom.operators.mapping import map_schema
from chartloom.operators.requests import hits_to_request, to_nlp_request
from chartloom.operators.responses import parse_deid, parse_nlp
from chartloom.operators.textops import scrub_text
from chartloom.plans.transform import Param, Transform


class SchemaMap(Transform):
    """Map columns to another schema."""

    params: ClassVar = {
        "mapping": Param(required=True, doc="{target: source | [sources] | None}"),
        "preserve_unmapped": Param(True, allowed=(True, False)),
        "first_non_empty": Param((), doc="composite targets that take the first value"),
    }

    def apply(self, df: DataFrame) -> tuple[DataFrame, None]:
        return map_schema(df, self.mapping, self.preserve_unmapped, self.first_non_empty), None


class TextScrub(Transform):
    """Scrub one text column."""

    params: ClassVar = {"text_col": Param("text", required=True)}

    def apply(self, df: DataFrame) -> tuple[DataFrame, None]:
        return scrub_text(df, self.text_col), None


class AssembleDocuments(Transform):
    """Put multi-part documents together and find their payload."""

    params: ClassVar = {
        "id_col": Param("id", required=True),
        "seq_col": Param("blob_sequence_num"),
        "bin_col": Param("binarydoc", required=True),
        "ordinal_col": Param("ordinal", required=True),
        "dup": Param(FAIL, allowed=(FAIL, KEEP_FIRST, KEEP_LAST)),
        "encoding": Param("base64", allowed=("base64", "raw")),
    }

    def apply(self, df: DataFrame) -> DataFrame:
        whole = assemble_documents(
            df, self.id_col, self.seq_col, self.bin_col, self.ordinal_col, self.dup, self.encoding
        )
        return resolve_documents(whole, self.bin_col)


class NlpRequests(Transform):
    """Requests for a language service; too short text fails."""

    params: ClassVar = {
        "text_col": Param("text", required=True),
        "id_col": Param("_id", required=True),
        "min_chars": Param(2),
    }

    def apply(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return hits_to_request(df, self.text_col, self.id_col, self.min_chars)


class AnnotationParse(Transform):
    """Service responses to annotation rows or de-identified documents."""

    params: ClassVar = {
        "id_col": Param("_id", required=True),
        "text_col": Param("text", required=True),
        "output": Param("annotations", allowed=("annotations", "deid")),
        "keep_annotations": Param(True, allowed=(True, False)),
        "empty_text": Param("drop", allowed=("drop", "restore")),
        "no_annotations": Param("restore", allowed=("drop", "restore")),
    }

    def apply(self, df: DataFrame) -> tuple[DataFrame, None]:
        if self.output == "annotations":
            return parse_nlp(df, self.id_col), None
        return parse_deid(df, self.text_col, self.text_col, self.keep_annotations, self.empty_text, self.no_annotations), None


def annotate_documents(
    documents: DataFrame,
    ledger: DataFrame,
    make_client: Callable[[], ServiceCall],
    answer_schema: str,
    text_col: str = "text",
    id_col: str = "docid",
    batch_size: int = 100,
) -> DataFrame:
    """Documents that are not in the ledger, with the answer of a language service.

    Filtering and pruning happen before the call, which Catalyst cannot see into.
    The result has ``error`` for calls that failed.
    """
    pending = not_yet_processed(documents, ledger, id_col)
    requests = to_nlp_request(pending, text_col).withColumn("id", F.col("footer")[id_col].cast("string"))
    return enrich(requests, make_client, ["id", "text"], answer_schema, batch_size)
