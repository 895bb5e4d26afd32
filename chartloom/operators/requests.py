"""Request records for text extraction and language services."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.binary import base64_text, decode_base64
from chartloom.functions.names import named
from chartloom.operators.records import json_column, only, rest_struct


def to_nlp_request(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``text`` (empty when missing) and ``footer`` with all other columns."""
    text = F.coalesce(named(text_col).cast("string"), F.lit("")) if text_col in df.columns else F.lit("")
    return df.select(text.alias("text"), rest_struct(df, [text_col]).alias("footer"))


def to_ocr_request(df: DataFrame, bin_col: str = "binarydoc", mode: str = "base64") -> DataFrame:
    """``binary_data`` and ``footer``; a null payload is kept as null.

    ``base64`` mode encodes a binary column.  Text columns hold their payload
    encoded already and need ``raw``.
    """
    kind = _payload_kind(df, bin_col, mode)
    payload = base64_text(named(bin_col)) if kind == "base64" else named(bin_col)
    return df.select(payload.alias("binary_data"), rest_struct(df, [bin_col]).alias("footer"))


def binary_to_base64(df: DataFrame, bin_col: str = "binarydoc", mode: str = "base64") -> DataFrame:
    """The binary column as base64 text (or untouched), moved to first place."""
    kind = _payload_kind(df, bin_col, mode)
    payload = base64_text(named(bin_col)) if kind == "base64" else named(bin_col)
    return df.select(payload.alias(bin_col), *only(df, [c for c in df.columns if c != bin_col]))


def _payload_kind(df: DataFrame, bin_col: str, mode: str) -> str:
    if mode not in ("base64", "raw"):
        raise ValueError(f"mode must be 'base64' or 'raw', not {mode!r}")
    if mode == "base64" and not isinstance(df.schema[bin_col].dataType, T.BinaryType):
        raise ValueError(f"column {bin_col!r} is not binary: use mode='raw' for text that is encoded already")
    return mode


def unwrap_hit(df: DataFrame, wrappers: Sequence[str] = ("fields", "_source")) -> DataFrame:
    """The record inside a search hit: ``fields``, else ``_source``, else itself.

    Columns of the wrappers come out at top level; for each row the first wrapper
    that is not null gives all values.  Other top-level columns (``_id``) stay.
    """
    present = [w for w in wrappers if w in df.columns]
    if not present:
        return df
    inner = {w: df.schema[w].dataType.names for w in present}
    plain = [c for c in df.columns if c not in present]
    names = list(dict.fromkeys(plain + [n for w in present for n in inner[w]]))

    def value(name: str) -> Column:
        own = named(name) if name in plain else F.lit(None)
        if not any(name in inner[w] for w in present):
            return own
        branches = None
        for w in present:
            found = named(w)[name] if name in inner[w] else F.lit(None)
            branches = F.when(named(w).isNotNull(), found) if branches is None else branches.when(named(w).isNotNull(), found)
        return branches.otherwise(own)

    return df.select(*[value(n).alias(n) for n in names])


def hits_to_request(
    df: DataFrame, text_col: str = "text", id_col: str = "_id", min_chars: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(requests with ``id``, ``text`` and ``footer``; records with too short text).

    The id is part of the footer too.
    """
    records = unwrap_hit(df)
    if id_col not in records.columns:
        raise ValueError(f"no id column {id_col!r} in {records.columns}")
    ok, invalid = split_valid(records, F.length(named(text_col)) >= min_chars)
    requests = ok.select(
        named(id_col).alias("id"), named(text_col).alias("text"), rest_struct(ok, [text_col]).alias("footer")
    )
    return requests, invalid.withColumn("error", F.lit(f"text shorter than {min_chars} characters"))


def split_valid(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where ``predicate`` is true, all other rows)."""
    holds = F.coalesce(predicate, F.lit(False))
    return df.filter(holds), df.filter(~holds)


def extract_payload(df: DataFrame, bin_col: str = "binarydoc", mode: str = "base64") -> DataFrame:
    """``content`` holds the payload bytes; every other column becomes text.

    ``base64`` mode decodes a text payload, null when it is not valid.
    """
    if mode not in ("base64", "raw"):
        raise ValueError(f"mode must be 'base64' or 'raw', not {mode!r}")
    payload = decode_base64(named(bin_col)) if mode == "base64" else named(bin_col).cast("binary")
    others = [_attribute_text(df, c).alias(c) for c in df.columns if c != bin_col]
    return df.select(payload.alias("content"), *others)


def to_attributes(df: DataFrame, content_col: str) -> DataFrame:
    """``content``, ``attributes`` (text map of the rest) and ``attribute_list``."""
    names = [c for c in df.columns if c != content_col]
    pairs = [x for c in names for x in (F.lit(c), _attribute_text(df, c))]
    return df.select(
        named(content_col).cast("string").alias("content"),
        F.create_map(*pairs).alias("attributes"),
        F.array(*[F.lit(c) for c in df.columns]).alias("attribute_list"),
    )


def _attribute_text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(named(name))
    return named(name).cast("string")


def request_batches(df: DataFrame, batch_size: int = 1000, max_chars: int = 2_000_000) -> DataFrame:
    """One ``{"content": ...}`` body per batch of records of a partition.

    ``content`` is an object for a batch of one and a list otherwise.  A batch is
    closed at ``batch_size`` records or ``max_chars`` characters.  Records are
    turned to JSON natively; the Python step only joins text, a batch at a time,
    and there is no shuffle.
    """
    rows = df.select(json_column(df).alias("body"))

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        size = 0
        for batch in batches:
            done = []
            for body in batch["body"]:
                if held and (len(held) >= batch_size or size + len(body) > max_chars):
                    done.append((_content(held), len(held)))
                    held, size = [], 0
                held.append(body)
                size += len(body)
            yield pd.DataFrame(done, columns=["request", "n_records"])
        if held:
            yield pd.DataFrame([(_content(held), len(held))], columns=["request", "n_records"])

    return rows.mapInPandas(bodies, "request string, n_records long")


def _content(bodies: list[str]) -> str:
    inner = bodies[0] if len(bodies) == 1 else "[" + ",".join(bodies) + "]"
    return '{"content":' + inner + "}"
