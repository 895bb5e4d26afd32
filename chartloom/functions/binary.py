"""Byte functions.

A cast between BINARY and STRING keeps the bytes as they are, and ``replace`` and
``substring_index`` search byte by byte.  Positions are therefore byte lengths of
the part before (or after) a marker, with no decode of the payload.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker bytes around a stored payload, longest first.
BLOB_MARKERS: tuple[str, ...] = ("\nocf_blob\x00", "ocf_blob\x00", "ocr_blob\x00")


def base64_text(col: Column) -> Column:
    """Base64 on one line (the built-in breaks lines every 76 characters)."""
    return F.replace(F.base64(col.cast("binary")), F.lit("\r\n"), F.lit(""))


def decode_base64(col: Column) -> Column:
    """Bytes of base64 text; null when it is not valid."""
    return F.try_to_binary(col, F.lit("base64"))


def is_strict_base64(col: Column) -> Column:
    """Valid alphabet only, whole groups of four, padding at the end."""
    return (F.length(col) % 4 == 0) & col.rlike(r"^[A-Za-z0-9+/]*={0,2}\z")


def head_hex(col: Column, n: int = 16) -> Column:
    """The first ``n`` bytes as small-letter hex."""
    return F.lower(F.hex(F.substring(col, 1, n)))


def strip_markers(col: Column, markers: Iterable[str] = BLOB_MARKERS) -> Column:
    """Take the wrapper markers out of a binary column."""
    text = col.cast("string")
    for marker in markers:
        text = F.replace(text, F.lit(marker), F.lit(""))
    return text.cast("binary")


def stream_marks(col: Column, start: str, end: str) -> tuple[Column, Column]:
    """(bytes before the first ``start``, bytes after the last ``end``).

    Either is the size of the whole column where its marker is absent.
    """
    text = col.cast("string")
    return F.octet_length(F.substring_index(text, start, 1)), F.octet_length(F.substring_index(text, end, -1))


def cut_stream(col: Column, before: Column, after: Column, end: str) -> tuple[Column, Column]:
    """(the stream between two marks, true if it starts but never ends)."""
    size = F.octet_length(col)
    has_start = before < size
    ended = (after < size) & (size - after - len(end) >= before)
    found = F.when(has_start & ended, col.substr(before + 1, size - after - before))
    return found, F.coalesce(has_start & ~ended, F.lit(False))


def bytes_between(col: Column, start: str, end: str) -> tuple[Column, Column]:
    """(bytes from the first ``start`` to the last ``end``, true if unterminated).

    The bytes are null when ``start`` is absent or nothing ends it.
    """
    return cut_stream(col, *stream_marks(col, start, end), end)


# How a stream begins and ends inside a payload.
PDF = ("%PDF-", "%%EOF")
RTF = ("{\\rtf", "}")


def extract_pdf(col: Column) -> tuple[Column, Column]:
    """Embedded PDF bytes and whether a PDF starts but never ends."""
    return bytes_between(strip_markers(col), *PDF)


def extract_rtf(col: Column) -> tuple[Column, Column]:
    """Embedded RTF bytes and whether an RTF starts but never ends."""
    return bytes_between(strip_markers(col), *RTF)
