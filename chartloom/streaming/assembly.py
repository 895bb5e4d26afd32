"""Assembly of documents whose parts arrive in different batches.

A document's state is one value: how many parts are there, of which kind, from where to
where, and the parts that wait, if they are few.  Parts of larger documents wait in
entries for ``PLACES`` places each.  A batch reads and writes the value and the entries it
has parts for, once each, and no others; the rest is read once, when the document is
whole.  A document that arrives whole leaves nothing but the mark that it is closed.
A document is emitted when ``total`` different parts are there.  With a time limit, a
processing-time timer sends what stays incomplete to the failures.

Documents are dealt in ``BUCKETS``, and Spark calls the Python side once a batch for a bucket,
not for a document: the calls and what they give and return take longer than the work.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chartloom.functions.names import named
from chartloom.operators.blobs import FAIL, KEEP_FIRST, KEEP_LAST

_OUT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("blob_parts", T.LongType()),
    T.StructField("error", T.StringType()),
])
#: Places that share an entry of state: a call for so many parts, and no more written again for one that comes alone.
PLACES = 32
#: What documents are dealt in by a hash of their id.  Checkpoints depend on it.
BUCKETS = 4096
#: A bucket's documents are read one after the other as a whole if a batch has parts for so many, and for half of them.
MANY = 16
#: Assembled bytes and documents that leave a task together.
OUT_BYTES, OUT_ROWS = 32 << 20, 1000
#: What is known of a document.
KNOWN = ("numbered", "unnumbered", "low", "high", "total")

_ID = T.StructType([T.StructField("id", T.StringType())])
#: As JSON, for a value of many columns takes longer to hand over: what is known, when its time is up, its
#: blocks that are stored apart, and the parts that are not.  Empty once it is closed.
_DOCUMENT = T.StructType([T.StructField("state", T.StringType())])
#: Where a part stands: by its sequence number, or by its ordinal where it has none.
_BLOCK = T.StructType([T.StructField("id", T.StringType()), T.StructField("numbered", T.BooleanType()), T.StructField("block", T.LongType())])
_PARTS = T.StructType([T.StructField("parts", T.StringType())])
_DUE, _IDS = T.StructType([T.StructField("due", T.LongType())]), T.StructType([T.StructField("ids", T.StringType())])
_DONE = T.StructType([T.StructField("emitted", T.BooleanType())])


class _Document:
    """State of one document of a bucket, read when it is asked for and written by ``store``.

    ``known``, ``parts``, ``done`` and ``handle`` have the calls of a document's own states and of its timers.
    """

    def __init__(self, bucket: _Buckets, key: str) -> None:
        self.bucket, self.id = bucket, key
        stored = bucket.value_of(key)
        self.is_stored, self.is_closed = stored is not None, stored is not None and not stored[0]
        known, due, blocks, held = json.loads(stored[0]) if stored is not None and stored[0] else (None, None, (), ())
        self.before: tuple | None = known and tuple(known)
        self.due: int | None = due
        self.blocks: dict[tuple[bool, int], None] = {(numbered, block): None for numbered, block in blocks}
        self.held: dict[tuple[bool, int], list] = {(numbered, block): parts for numbered, block, parts in held}
        self.read: dict[tuple[bool, int], list] = {}
        self.new: tuple | None = None
        self.changed: dict[tuple[bool, int], list] = {}
        self.closing = False
        self.known, self.parts, self.done, self.handle = _Known(self), _Waiting(self), _Closed(self), _Timers(self)

    def block(self, at: tuple[bool, int]) -> list | None:
        """The parts of a block, if there are any."""
        if at not in self.blocks:
            return self.held.get(at)
        if at not in self.read:
            self.read[at] = json.loads(self.bucket.parts.getValue((self.id, *at))[0])
        return self.read[at]

    def store(self) -> None:
        """Write what has changed."""
        if self.closing:
            for at in self.blocks:
                self.bucket.parts.removeKey((self.id, *at))
            self.bucket.close_document(self.id, self.is_stored)
        elif self.new is not None:
            self.held |= {at: parts for at, parts in self.changed.items() if at not in self.blocks}
            # Once a document has blocks of its own, new ones join them.
            apart = list(self.held) if self.blocks or sum(map(len, self.held.values())) > PLACES else []
            for at in [*(at for at in self.changed if at in self.blocks), *apart]:
                self.bucket.parts.updateValue((self.id, *at), (json.dumps(self.changed.get(at, self.held.get(at))),))
            self.blocks |= dict.fromkeys(apart)
            held = {} if apart else self.held
            state = self.new, self.due, list(self.blocks), [(*at, parts) for at, parts in held.items()]
            self.bucket.documents.updateValue((self.id,), (json.dumps(state),))


class _Known:
    def __init__(self, document: _Document) -> None:
        self.document = document

    def get(self) -> tuple | None:
        return self.document.before

    def update(self, value: tuple) -> None:
        self.document.new = value

    def clear(self) -> None:
        pass


class _Waiting:
    def __init__(self, document: _Document) -> None:
        self.document = document

    def getValue(self, at: tuple[bool, int]) -> tuple | None:  # noqa: N802
        parts = self.document.block(at)
        return None if parts is None else (parts,)

    def updateValue(self, at: tuple[bool, int], value: tuple) -> None:  # noqa: N802
        self.document.changed[at] = value[0]

    def iterator(self) -> Iterator[tuple]:
        for at in [*self.document.held, *self.document.blocks]:
            yield at, (self.document.block(at),)

    def clear(self) -> None:
        pass


class _Closed:
    def __init__(self, document: _Document) -> None:
        self.document = document

    def exists(self) -> bool:
        return self.document.is_closed or self.document.bucket.was_closed(self.document.id)

    def update(self, value: tuple) -> None:
        self.document.closing = True


class _Timers:
    """One timer of a bucket stands for all its documents that are due at that time; a closed one is passed over."""

    def __init__(self, document: _Document) -> None:
        self.document = document

    def registerTimer(self, due: int) -> None:  # noqa: N802
        self.document.due = due
        self.document.bucket.due_now.setdefault(due, []).append(self.document.id)


class _Buckets(StatefulProcessor):
    """Hands the parts of a bucket's documents to an ``_Assembler``, document by document."""

    def __init__(self, dup: str, ordered: bool, timeout_ms: int | None, keep_closed_ms: int | None) -> None:
        self.assembler = _Assembler(dup, ordered, timeout_ms, keep_closed_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.documents = handle.getMapState("documents", _ID, _DOCUMENT)
        self.parts = handle.getMapState("parts", _BLOCK, _PARTS)
        if self.assembler.timeout_ms is not None:
            self.due = handle.getMapState("due", _DUE, _IDS)
        # Remembering a closed document for a while is enough to tell its late parts.
        if self.assembler.keep_closed_ms is not None:
            self.done = handle.getMapState("done", _ID, _DONE, self.assembler.keep_closed_ms)

    def _read(self, ids: dict[str, list[dict]]) -> None:
        """Values of all documents, if most are asked for: they come many at a time, single ones take a call each."""
        self.values: dict[str, tuple] = {}
        self.is_read = False
        if len(ids) >= MANY:
            for (key,), value in self.documents.iterator():
                if len(self.values) >= 2 * len(ids):
                    return
                self.values[key] = value
            self.is_read = True

    def value_of(self, key: str) -> tuple | None:
        if self.is_read or key in self.values:
            return self.values.get(key)
        return self.documents.getValue((key,))

    def was_closed(self, key: str) -> bool:
        return self.assembler.keep_closed_ms is not None and self.done.containsKey((key,))

    def close_document(self, key: str, stored: bool) -> None:
        if self.assembler.keep_closed_ms is None:
            self.documents.updateValue((key,), ("",))
            return
        if stored:
            self.documents.removeKey((key,))
        self.done.updateValue((key,), (True,))

    def _at(self, key: str) -> _Document:
        document, mine = _Document(self, key), self.assembler
        mine.known, mine.parts, mine.done, mine.handle = document.known, document.parts, document.done, document.handle
        return document

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        return _frames(self._whole(rows, timerValues))

    def _whole(self, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[Row]:
        by_id: dict[str, list[dict]] = {}
        for frame in rows:
            seq, ordinal, total = (
                [v if there else None for v, there in zip(frame[n].tolist(), frame[f"has_{n}"].tolist())] for n in ("seq", "ordinal", "total")
            )
            for id_, *part in zip(frame["id"].tolist(), seq, ordinal, frame["bin"].tolist(), total):
                by_id.setdefault(id_, []).append(dict(zip(("seq", "ordinal", "bin", "total"), part)))
        self.due_now: dict[int, list[str]] = {}
        self._read(by_id)
        for id_, parts in by_id.items():
            document = self._at(id_)
            yield from self.assembler.handleInputRows((id_,), iter(parts), timerValues)
            document.store()
        for due, ids in self.due_now.items():
            before = self.due.getValue((due,))
            self.due.updateValue((due,), (json.dumps([*([] if before is None else json.loads(before[0])), *ids]),))
            if before is None:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        return _frames(self._expired(key, timerValues, expiredTimerInfo))

    def _expired(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = self.due.getValue((due,))
        self._read({})
        for id_ in [] if held is None else json.loads(held[0]):
            document = self._at(id_)
            # It may be closed by now, or forgotten and begun anew.
            if document.due == due:
                yield from self.assembler.handleExpiredTimer((id_,), timerValues, expiredTimerInfo)
                document.store()
        self.due.removeKey((due,))

    def close(self) -> None:
        pass


def _frames(found: Iterator[Row]) -> Iterator[pd.DataFrame]:
    """The rows in frames of about ``OUT_BYTES`` or ``OUT_ROWS``."""
    rows: list[Row] = []
    size = 0
    for row in found:
        rows.append(row)
        size += len(row["payload"] or b"")
        if size >= OUT_BYTES or len(rows) >= OUT_ROWS:
            yield _frame(rows)
            rows, size = [], 0
    if rows:
        yield _frame(rows)


def _frame(rows: list[Row]) -> pd.DataFrame:
    frame = pd.DataFrame([tuple(row) for row in rows], columns=_OUT.names, dtype=object)
    return frame.astype({"blob_parts": "Int64"})


class _Assembler:
    """What to do with the parts of one document, whose states are ``known``, ``parts`` and ``done``."""

    def __init__(self, dup: str, ordered: bool, timeout_ms: int | None, keep_closed_ms: int | None) -> None:
        self.dup, self.ordered, self.timeout_ms, self.keep_closed_ms = dup, ordered, timeout_ms, keep_closed_ms

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.known.get()
        fresh = before is None
        if fresh and self.done.exists():
            yield _row(key[0], error="part arrived after the document was closed")
            return
        known = dict(zip(KNOWN, (0, 0, None, None, None) if before is None else before))
        blocks: dict[tuple[bool, int], dict[int, tuple]] = {}
        error = None
        for row in rows:
            error = self._take(known, blocks, fresh, row["seq"], row["ordinal"], row["bin"], row["total"]) or error
        here = known["numbered"] + known["unnumbered"]
        if error is not None:
            yield _row(key[0], error=error)
        elif known["total"] is not None and here >= known["total"]:
            yield self._document(key[0], known, blocks)
        else:
            for block, held in blocks.items():
                self.parts.updateValue(block, ([(at, *part) for at, part in held.items()],))
            self.known.update(tuple(known.values()))
            if fresh and self.timeout_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            return
        self._close(fresh)

    def _take(
        self, known: dict, blocks: dict, fresh: bool, seq: int | None, ordinal: int | None, text: str | None, total: int | None
    ) -> str | None:
        """Put a part in its place; what is wrong with it, if anything is."""
        place = seq if seq is not None else ordinal if self.ordered else None
        if place is None or total is None:
            return "part without a sequence number or total"
        known["total"] = total
        numbered = seq is not None
        block = numbered, place // PLACES
        if block not in blocks:
            stored = None if fresh else self.parts.getValue(block)
            blocks[block] = {} if stored is None else _held(stored)
        parts = blocks[block]
        if place not in parts:
            parts[place] = text, ordinal
            known["numbered" if numbered else "unnumbered"] += 1
            known["low"] = place if known["low"] is None else min(known["low"], place)
            known["high"] = place if known["high"] is None else max(known["high"], place)
            return None
        held, before = parts[place]
        if held == text:  # the same part delivered again
            return None
        if not numbered:
            return "ordinal of a part without sequence number comes twice"
        if self.dup == FAIL:
            return "duplicate sequence number"
        new, old = (ordinal, text or ""), (before, held or "")
        if new < old if self.dup == KEEP_FIRST else new > old:
            parts[place] = text, ordinal
        return None

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.done.exists():
            yield _row(key[0], error="parts missing at the time limit")
            self._close(False)

    def _document(self, key: str, known: dict, blocks: dict) -> Row:
        if known["numbered"] and known["unnumbered"]:
            return _row(key, error="sequence number on some parts only")
        here = [blocks]
        if sum(map(len, blocks.values())) < known["numbered"] + known["unnumbered"]:
            here.append({k: _held(v) for k, v in ((tuple(k), v) for k, v in self.parts.iterator()) if k not in blocks})
        held = {at: part[0] for some in here for parts in some.values() for at, part in parts.items()}
        if any(v is None or v == "" for v in held.values()):
            return _row(key, error="missing payload in a part")
        if known["numbered"] and known["high"] - known["low"] + 1 != len(held):
            return _row(key, error="sequence gap")
        try:
            payload = b"".join(base64.b64decode(held[at], validate=True) for at in sorted(held))
        except (binascii.Error, ValueError, TypeError):
            return _row(key, error="invalid base64 in a part")
        return _row(key, payload, len(held))

    def _close(self, fresh: bool) -> None:
        if not fresh:
            self.parts.clear()
            self.known.clear()
        self.done.update((True,))


def _held(stored: tuple) -> dict[int, tuple]:
    """The parts of an entry by their places."""
    return {at: (text, ordinal) for at, text, ordinal in stored[0]}


def _row(key: str, payload: bytes | None = None, parts: int | None = None, error: str | None = None) -> Row:
    return Row(id=key, payload=payload, blob_parts=parts, error=error)


def stream_assemble_blobs(
    df: DataFrame,
    id_col: str,
    seq_col: str,
    bin_col: str,
    total_col: str,
    timeout_ms: int | None = None,
    ordinal_col: str | None = None,
    dup: str = FAIL,
    keep_closed_ms: int | None = None,
) -> DataFrame:
    """``id, payload, blob_parts, error`` as documents complete or run out of time.

    ``total_col`` says how many parts a document has.  Needs the RocksDB state
    store; state of a document with over ``PLACES`` parts is spread over map entries, one for each ``PLACES``.
    A task holds a bucket's share of a batch, one of ``BUCKETS``, in memory.

    With ``ordinal_col`` a document none of whose parts has a sequence number is put
    together in the order of its ordinals.  A part that comes again as it was is passed
    over; one that comes with other bytes fails the document, or with ``dup`` the one with
    the lowest (``keep_first``) or highest ordinal (``keep_last``) stays, as far as it comes
    before the document is whole.

    Without ``timeout_ms`` incomplete documents wait, and an ``availableNow`` run
    ends when its input does.  With it, timers are checked in batches without data
    too, so such a query belongs on a trigger with an interval.  Closed documents are
    remembered for ``keep_closed_ms``, for ever by default; a part that comes later than
    that begins a document anew.
    """
    if dup not in (FAIL, KEEP_FIRST, KEEP_LAST):
        raise ValueError(f"dup must be 'fail', 'keep_first' or 'keep_last', not {dup!r}")
    if dup != FAIL and ordinal_col is None:
        raise ValueError(f"dup={dup!r} needs an ordinal_col: arrival is no order")
    parts = df.select(
        named(id_col).cast("string").alias("id"),
        named(seq_col).cast("bigint").alias("seq"),
        (named(ordinal_col) if ordinal_col else F.lit(None)).cast("bigint").alias("ordinal"),
        named(bin_col).cast("string").alias("bin"),
        named(total_col).cast("bigint").alias("total"),
    )
    nameless = F.col("id").isNull() | (F.col("id") == "")
    # Parts without an id may be very many; they never meet in one group.
    unnamed = parts.filter(nameless).select(
        "id",
        F.lit(None).cast("binary").alias("payload"),
        F.lit(None).cast("bigint").alias("blob_parts"),
        F.lit("missing document id").alias("error"),
    )
    # Numbers without nulls: pandas makes floats of those that have some.
    numbers = [c for n in ("seq", "ordinal", "total") for c in (F.coalesce(n, F.lit(0).cast("bigint")).alias(n), F.col(n).isNotNull().alias(f"has_{n}"))]
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    whole = parts.filter(~nameless).select(bucket, "id", "bin", *numbers).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Buckets(dup, ordinal_col is not None, timeout_ms, keep_closed_ms),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="None" if timeout_ms is None and keep_closed_ms is None else "ProcessingTime",
    )
    return whole.unionByName(unnamed)
