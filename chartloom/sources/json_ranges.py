"""Files with a JSON array read by byte ranges, so that one big file takes many tasks.

Spark cuts a file into ranges wherever its text reader may: at a closing brace.  What a
range holds means nothing by itself, because it may begin inside a string or at any depth.
So every range is first summed up for both cases, a start outside a string and one inside:
what it does to the state and to the depth.  Summaries are put together in the order of
the ranges, which gives each range the state it begins in; then each cuts its own records.
Only what lies across the ends of ranges is put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.session import checkpoint_folder

UNREADABLE = "_unreadable"
BRACE = b"}"
BLANKS = b" \t\r\n"
#: Text between ranges' records: the end of one record, a whole one, the begin of one.
HEAD, WHOLE, TAIL = 0, 1, 2
#: What a file is made of, by its first character.
BASES = {"{": 0, "[": 1}


def _steps() -> np.ndarray:
    table = np.zeros(256, dtype=np.int8)
    for opening, closing in ("{}", "[]"):
        table[ord(opening)], table[ord(closing)] = 1, -1
    return table


def lex(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets, what each does to the depth, whether an odd number of quote marks stands before it, and how many stand in all.

    ``data`` begins outside an escape.  A quote mark after an odd run of backslashes is text.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(raw == 0x22)
    slashes = np.flatnonzero(raw == 0x5C)
    if len(slashes) and len(quotes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        length = np.diff(np.append(first, len(slashes)))
        after = (slashes[first] + length)[length % 2 == 1]
        escaped = np.zeros(len(raw) + 1, dtype=bool)
        escaped[after] = True
        quotes = quotes[~escaped[quotes]]
    step = _STEPS[raw]
    places = np.flatnonzero(step)
    odd = np.searchsorted(quotes, places) & 1
    return places, step[places].astype(np.int64), odd, len(quotes)


_STEPS = _steps()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are of one range of one file."""
    n = batch.num_rows
    if not n:
        return
    start, path = batch.column("start").to_numpy(), batch.column("path")
    new = np.ones(n, dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | pc.not_equal(path.slice(1), path.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new).tolist()
    yield from zip(first, [*first[1:], n])


def _chunk(batch: pa.RecordBatch, low: int, high: int) -> bytes:
    """The rows' texts as they stand in the file, each with the brace that ends it."""
    return BRACE.join(batch.column("value").slice(low, high - low).to_pylist()) + BRACE


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: what it does to a reader that begins outside a string (0) or inside (1)."""
    held: dict | None = None

    def row(done: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([done], schema=_SUMMARY)

    for batch in batches:
        for low, high in _runs(batch):
            path, start = batch.column("path")[low].as_py(), batch.column("start")[low].as_py()
            if held is None or (held["path"], held["start"]) != (path, start):
                if held is not None:
                    yield row(held)
                size = batch.column("size")[low].as_py()
                held = {"path": path, "start": start, "size": size, "octets": 0, "pieces": 0, "first": None, "flips": 0, "delta0": 0, "delta1": 0}
            data = _chunk(batch, low, high)
            _, step, odd, quotes = lex(data)
            by_parity = [int(step[odd == k].sum()) for k in (0, 1)]
            held["delta0"] += by_parity[held["flips"]]
            held["delta1"] += by_parity[1 - held["flips"]]
            held["flips"] ^= quotes & 1
            held["octets"] += len(data)
            held["pieces"] += high - low
            if held["first"] is None and (text := data.lstrip(BLANKS)):
                held["first"] = text[:1].decode("latin-1")
    if held is not None:
        yield row(held)


_SUMMARY = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("octets", pa.int64()), ("pieces", pa.int64()), ("first", pa.string()),
    ("flips", pa.int64()), ("delta0", pa.int64()), ("delta1", pa.int64()),
])
_SUMMARY_DDL = "path string, start long, size long, octets long, pieces long, first string, flips long, delta0 long, delta1 long"
_PIECES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("lead", pa.string()), ("body", pa.binary())])
_PIECES_DDL = "path string, start long, kind int, lead string, body binary"


def range_states(summaries: DataFrame) -> DataFrame:
    """The state every range begins in, from the summaries of all ranges of its file before it.

    ``path``, ``start``, ``inside`` (a string: 0 or 1), ``depth``, ``base`` (the depth
    between records; null for a blank file), ``last``, ``ended`` (whether the file's last
    text has its brace) and ``broken`` (why the file as a whole can't be JSON).
    """
    ordered = Window.partitionBy("path").orderBy("start")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    zero = F.lit(0).cast("long")
    rows = summaries.withColumn("inside", F.coalesce(F.sum("flips").over(before), zero) % 2)
    rows = rows.withColumn("delta", F.when(F.col("inside") == 0, F.col("delta0")).otherwise(F.col("delta1")))
    rows = rows.withColumn("depth", F.coalesce(F.sum("delta").over(before), zero))
    # The reader drops a byte order mark of three bytes; a text without its brace counts one byte too many.
    more = F.sum("octets").over(whole) - F.col("size")
    rows = rows.withColumns({
        "last": F.col("start") == F.max("start").over(whole),
        "ended": more.isin(0, -3),
        "opening": F.first("first", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "end_inside": F.sum("flips").over(whole) % 2,
        "end_depth": F.sum("delta").over(whole) + F.when(more.isin(0, -3), 0).otherwise(1),
        "odd_size": ~more.isin(0, -3, 1, -2),
    })
    base = F.when(F.col("opening") == "{", BASES["{"]).when(F.col("opening") == "[", BASES["["])
    # The brace that is taken to end a blank file's only text isn't there.
    blank = F.col("opening").isNull() | ((F.col("opening") == "}") & ~F.col("ended") & (F.sum("pieces").over(whole) == 1))
    broken = (
        F.when(F.col("odd_size"), "compressed, or it has changed: read it whole")
        .when(blank, None)
        .when(base.isNull(), "neither an object nor an array of objects")
        .when((F.col("end_inside") != 0) | (F.col("end_depth") != 0), "brackets or quote marks that don't match")
    )
    return rows.select(
        "path", "start", F.col("inside").cast("int").alias("inside"), "depth", base.alias("base"), "last", "ended", broken.alias("broken")
    )


def _cutter(only_seams: bool):  # noqa: ANN202
    """A function that cuts the texts of ranges into records, or gives what lies across their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict | None = None
        out: list[tuple] = []

        def emit(kind: int, body: bytes) -> None:
            if kind == WHOLE:
                if only_seams:
                    return
                at = body.find(b"{")
                out.append((here["path"], here["start"], kind, body[:at].strip(BLANKS).decode("utf-8", "replace"), body[at:]))
            elif only_seams:
                out.append((here["path"], here["start"], kind, None, body))

        def take(data: bytes) -> None:
            """Cut one stretch of a range; what is left of it waits for the next."""
            places, step, odd, quotes = lex(data)
            outside = odd == here["inside"]
            places, depth = places[outside], here["depth"] + np.cumsum(step[outside])
            raw = np.frombuffer(data, dtype=np.uint8)
            ends = places[(raw[places] == BRACE[0]) & (depth == here["base"])] + 1
            low = 0
            for end in ends.tolist():
                body = b"".join([*here["rest"], data[low:end]])
                emit(WHOLE if here["cut"] else HEAD, body)
                here["rest"], here["cut"], low = [], True, end
            if low < len(data):
                here["rest"].append(data[low:])
            here["depth"] = int(depth[-1]) if len(depth) else here["depth"]
            here["inside"] ^= quotes & 1

        def close() -> None:
            data = here["waiting"]
            if here["last"] and not here["ended"]:
                data = data[:-1]
            if data:
                take(data)
            emit(TAIL, b"".join(here["rest"]))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _PIECES)], schema=_PIECES)
            out.clear()
            return made

        for batch in batches:
            for low, high in _runs(batch):
                row = {c: batch.column(c)[low].as_py() for c in batch.schema.names if c != "value"}
                if here is None or (here["path"], here["start"]) != (row["path"], row["start"]):
                    if here is not None and here["base"] is not None:
                        close()
                    if row["inside"] is None:
                        raise RuntimeError(f"the ranges of {row['path']} are not those it was summed up by: it or spark.sql.files.* has changed")
                    here = row | {"rest": [], "cut": False, "waiting": b""}
                elif here["base"] is not None and here["waiting"]:
                    take(here["waiting"])
                here["waiting"] = _chunk(batch, low, high)
            if out:
                yield batch_of()
        if here is not None and here["base"] is not None:
            close()
        if out:
            yield batch_of()

    return run


def read_json_ranges(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType,
    name_glob: str | None = None,
    whole_files: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Like ``read_json_records`` for files of any size: (one row per object, what can't be read).

    A file holds one object or an array of objects, in UTF-8, uncompressed, on one line
    or many.  With ``whole_files`` a file with anything unreadable fails whole, as there:
    one row ``path``, ``text`` (the first unreadable element, not the file), ``record``
    and ``error``.  Without, only the elements that can't be read do, each a row; a file
    whose brackets don't match fails whole either way.  Blank files hold nothing.
    What follows a file's one object, blanks apart, is an error.

    The files are read three times, in ranges of ``spark.sql.files.maxPartitionBytes``:
    for the summaries, for what lies across ranges, and for the records; a fourth time to
    tell whole files apart.  No record is shuffled but those across the ends of ranges.
    A task holds one batch of text and one record; the driver nothing.  One row of some
    100 bytes a range is broadcast.  The summaries hold for the ranges they were made of:
    a file or setting that changes before the rows are used is an error.
    """
    reader = spark.read.option("lineSep", BRACE.decode())
    if name_glob is not None:
        reader = reader.option("pathGlobFilter", name_glob).option("recursiveFileLookup", True)
    texts = reader.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"),
    )
    checkpoint_folder(spark)
    states = range_states(texts.mapInArrow(_summaries, _SUMMARY_DDL)).checkpoint()
    told = texts.select("path", "start", "value").join(F.broadcast(states), ["path", "start"], "left")
    told = told.select("path", "start", "inside", "depth", F.when(F.col("broken").isNull(), F.col("base")).alias("base"), "last", "ended", "value")
    bases = states.filter("base IS NOT NULL").groupBy("path").agg(F.first("base").alias("base"))

    seams = _seams(told.mapInArrow(_cutter(True), _PIECES_DDL).checkpoint()).join(F.broadcast(bases), "path")
    wholes = told.mapInArrow(_cutter(False), _PIECES_DDL)
    wholes = wholes.select("path", "lead", F.col("body").cast("string").alias("body"), F.lit(False).alias("first"), F.lit(False).alias("left"))
    wholes = wholes.join(F.broadcast(bases), "path")
    pieces = wholes.unionByName(seams)

    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*shape.fields, T.StructField(UNREADABLE, T.StringType())])
    record = F.from_json("body", marked, {"columnNameOfCorruptRecord": UNREADABLE})
    parsed = pieces.withColumn("between", _between()).withColumn("r", record)
    error = F.coalesce(
        F.col("between"),
        F.when(~F.col("left") & (F.col("r").isNull() | F.col("r")[UNREADABLE].isNotNull()), "not JSON, or not of the schema"),
    )
    read = parsed.withColumn("error", error)
    good = read.filter("error IS NULL AND NOT left")
    bad = read.filter("error IS NOT NULL").select(
        "path", F.concat("lead", F.when(F.col("left"), "").otherwise(F.col("body"))).alias("text"),
        F.to_json(F.col("r").dropFields(UNREADABLE)).alias("record"), "error",
    )
    nothing = F.lit(None).cast("string")
    files = states.filter("broken IS NOT NULL").groupBy("path").agg(F.first("broken").alias("error"))
    failed = bad.unionByName(files.select("path", nothing.alias("text"), nothing.alias("record"), "error"))
    if whole_files:
        failed = failed.groupBy("path").agg(F.first("text").alias("text"), F.first("record").alias("record"), F.first("error").alias("error"))
        good = good.join(failed.select("path"), "path", "left_anti")
    return good.select("r.*").drop(UNREADABLE), failed


def _seams(pieces: DataFrame) -> DataFrame:
    """Records that lie across ranges and what is left at files' ends, put together: ``path``, ``lead``, ``body``, ``first``, ``left``."""
    # The numbers are worked out without the texts: all ranges of a file meet in one task.
    ordered = Window.partitionBy("path").orderBy("start", "kind")
    heads = F.sum((F.col("kind") == HEAD).cast("int")).over(ordered)
    numbered = pieces.select("path", "start", "kind", (heads - (F.col("kind") == HEAD).cast("int")).alias("seam"))
    joined = pieces.join(numbered, ["path", "start", "kind"]).groupBy("path", "seam").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", F.col("body").cast("string").alias("body")))).alias("parts"),
        F.max((F.col("kind") == HEAD).cast("int")).alias("closed"),
    )
    text = F.array_join(F.col("parts")["body"], "")
    rows = joined.select("path", text.alias("text"), (F.col("seam") == 0).alias("first"), (F.col("closed") == 0).alias("left"))
    opening = F.when(F.col("left"), F.length("text")).otherwise(F.instr("text", "{") - 1)
    lead = F.regexp_replace(F.substring("text", F.lit(1), opening), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    body = F.when(~F.col("left"), F.substring("text", opening + 1, F.length("text")))
    return rows.select("path", lead.alias("lead"), body.alias("body"), "first", "left")


def _between() -> Column:
    """What is wrong with the text before a record, or with what is left after the last one."""
    array, first, left, lead = F.col("base") == BASES["["], F.col("first"), F.col("left"), F.col("lead")
    fits = (
        F.when(left & array & first, lead.rlike(r"^\[[ \t\r\n]*\]$"))
        .when(left & array, lead == "]")
        .when(left, lead == "")
        .when(array & first, lead == "[")
        .when(array, lead == ",")
        .otherwise(first & (lead == ""))
    )
    return F.when(~fits, "something that is no object beside the objects")
