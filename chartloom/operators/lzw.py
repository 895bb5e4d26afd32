"""Decoder for LZW-compressed payloads, run inside executor tasks.

Code stream: most significant bit first, codes of 9 bits that widen to 13 as the
table fills, 256 restarts the table, 257 ends the stream.

Table entry ``258 + i`` is the output of code ``i`` since the last restart plus the
next output byte, so it is a slice of the bytes already written.  The decoder keeps
only where each code's output starts; no strings are stored.  Widths depend on
nothing but a code's number since the restart, so codes are cut out of the bits a
block at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.binary import BLOB_MARKERS, PDF, RTF

# Fixed values of the code stream; a code gets one bit wider once this many precede it.
RESTART, END, FIRST_ENTRY = 256, 257, 258
WIDER_AFTER = (254, 766, 1790, 3838)
_BLOCK = 16_384
# Decoded bytes of one payload, and of the payloads that leave a task together.
MAX_DECODED, OUT_BYTES = 1_000_000_000, 32 << 20


def _codes(data: np.ndarray, bit: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bit after each) of the block of codes that begins at ``bit``.

    ``data`` has three spare bytes at its end; ``first`` is the number of codes since
    the restart.  Codes the data does not hold in full are left out.
    """
    size = 8 * (len(data) - 3)
    most = min(_BLOCK, (size - bit) // 9 + 1)
    widths = 9 + np.searchsorted(WIDER_AFTER, np.arange(first, first + most), side="right")
    ends = bit + np.cumsum(widths)
    n = int(np.searchsorted(ends, size, side="right"))
    widths, ends = widths[:n], ends[:n]
    begins = ends - widths
    at = begins >> 3
    window = (data[at] << 16) | (data[at + 1] << 8) | data[at + 2]
    return (window >> (24 - (begins & 7) - widths)) & ((1 << widths) - 1), ends


def lzw_decode(payload: bytes, most: int = MAX_DECODED) -> bytes:
    """Decode one payload; raises ``ValueError`` on a broken stream, or one that decodes to over ``most`` bytes."""
    data = np.frombuffer(payload + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    out = bytearray()
    starts: list[int] = []  # output position of each code since the restart
    bit = 0
    while True:
        codes, ends = _codes(data, bit, len(starts))
        marks = np.flatnonzero((codes == RESTART) | (codes == END))
        n = int(marks[0]) if len(marks) else len(codes)
        _expand(codes[:n].tolist(), starts, out)
        if len(out) > most:
            raise ValueError(f"decodes to more than {most} bytes")
        if len(marks):
            if codes[n] == END:
                return bytes(out)
            # The next code begins on the byte that held the last bit of this one.
            bit, starts = (int(ends[n]) - 1) // 8 * 8, []
        elif n < _BLOCK:
            raise ValueError("stream ends before its end code")
        else:
            bit = int(ends[-1])


def _expand(codes: list[int], starts: list[int], out: bytearray) -> None:
    """Write what the codes stand for."""
    for code in codes:
        here = len(out)
        if code < RESTART:
            out.append(code)
        else:
            entry = code - FIRST_ENTRY
            if entry >= len(starts):
                raise ValueError(f"code {code} is not in the table")
            begin = starts[entry]
            if entry + 1 < len(starts):
                out += out[begin : starts[entry + 1] + 1]
            else:
                # The entry being made right now: its last byte is its own first.
                out += out[begin:here]
                out.append(out[begin])
        starts.append(here)


def _stream_in(data: bytes) -> tuple[bytes, str] | None:
    """The PDF or else the RTF inside decoded bytes, with its kind."""
    for marker in BLOB_MARKERS:
        data = data.replace(marker.encode(), b"")
    for kind, (start, end) in (("pdf", PDF), ("rtf", RTF)):
        begin = data.find(start.encode())
        if begin < 0:
            continue
        stop = data.rfind(end.encode())
        if stop < begin:
            raise ValueError(f"decoded {kind} stream has no end marker")
        return data[begin : stop + len(end)], kind
    return None


def unpack(payload: bytes) -> dict[str, object]:
    """Decode one payload and take the document out of it."""
    row: dict[str, object] = dict.fromkeys(_UNPACKED.names)
    try:
        data = lzw_decode(payload)
    except ValueError as exc:
        return row | {"error": f"payload is no embedded stream and not LZW: {exc}"}
    if not data:
        return row | {"error": "LZW decode gave an empty payload"}
    row |= {"decompressed_len": len(data), "decompressed_head_hex": data[:16].hex()}
    try:
        found = _stream_in(data)
    except ValueError as exc:
        return row | {"error": str(exc)}
    stream, kind = found or (data, "")
    return row | {"payload": stream, "kind": kind}


_UNPACKED = T.StructType([
    T.StructField("payload", T.BinaryType()),
    T.StructField("kind", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("decompressed_len", T.LongType()),
    T.StructField("decompressed_head_hex", T.StringType()),
])
_NOTHING: dict[str, object] = dict.fromkeys(_UNPACKED.names)


@F.pandas_udf(_UNPACKED)
def _unpack_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    # A frame is sent on as soon as it is large, however many payloads came in together.
    def frame(rows: list[dict[str, object]]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_UNPACKED.names).astype({"decompressed_len": "Int64"})

    for batch in batches:
        rows, size = [], 0
        for p in batch:
            rows.append(_NOTHING if p is None else unpack(bytes(p)))
            size += len(rows[-1]["payload"] or b"")
            if size >= OUT_BYTES:
                yield frame(rows)
                rows, size = [], 0
        if rows:
            yield frame(rows)


# Marked so that a filter on the result is not pushed below the call, which would
# make every payload be decoded once for the filter and once for the result.
_unpack_once = _unpack_udf.asNondeterministic()


def unpacked(col: Column) -> Column:
    """``struct(payload, kind, error, decompressed_len, decompressed_head_hex)``; null in costs nothing."""
    return _unpack_once(col)
