"""Multi-part binary documents: assembly, checks, payload choice.

All documents are assembled the same way, whatever their number of parts.  Copies of a
part are merged first, by document and position, so that neither a part that came a
million times nor a document of a million parts is one task's; what is left is stored
once, and everything else reads it from there.  A document's facts (counts, first and
last position, size) come from an aggregate without payloads.  Payloads of documents that
passed and fit a cell then meet in order of position, and are joined while they
stream by: a task holds the document it is at and no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.binary import (
    PDF,
    RTF,
    base64_text,
    cut_stream,
    decode_base64,
    head_hex,
    is_strict_base64,
    stream_marks,
    strip_markers,
)
from chartloom.functions.names import named
from chartloom.operators.lzw import unpacked
from chartloom.operators.records import only
from chartloom.session import checkpoint_folder

FAIL, KEEP_FIRST, KEEP_LAST = "fail", "keep_first", "keep_last"

# A binary cell holds under 2 GiB.
MAX_BYTES = 2_000_000_000
# Assembled bytes and documents that leave a task together.
OUT_BYTES, OUT_ROWS = 32 << 20, 1000


def assemble_documents(
    df: DataFrame,
    id_col: str = "id",
    seq_col: str = "blob_sequence_num",
    bin_col: str = "binarydoc",
    ordinal_col: str = "ordinal",
    dup: str = FAIL,
    encoding: str = "base64",
    require_start: tuple[int, ...] | None = None,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per document; ``error`` is null for those that could be assembled.

    Parts are ordered by ``seq_col``, or by ``ordinal_col`` when no part of a
    document has a sequence number.  The other columns come from the part with
    the lowest ordinal.  Failures, with a null payload: no document id, sequence on
    some parts only or not a whole number, missing payload, duplicate sequence
    (``dup='fail'``), an ordinal that comes twice where parts have no sequence number,
    gap, a start outside ``require_start``, invalid base64, and documents of more than
    ``max_bytes`` decoded bytes, which no cell holds.

    The parts are read once, here: their merged copies are written to the checkpoint
    folder, and the frame reads those.
    """
    if dup not in (FAIL, KEEP_FIRST, KEEP_LAST):
        raise ValueError(f"dup must be 'fail', 'keep_first' or 'keep_last', not {dup!r}")
    if encoding not in ("base64", "raw"):
        raise ValueError(f"encoding must be 'base64' or 'raw', not {encoding!r}")
    kept = [c for c in df.columns if c not in (id_col, bin_col, ordinal_col)]
    parts = _parts(df, id_col, seq_col, bin_col, ordinal_col, kept, encoding)
    checkpoint_folder(df.sparkSession)
    merged = _merge_copies(parts, dup).checkpoint()

    no_id = F.col("id").isNull() | (F.col("id").cast("string") == "")
    nameless = merged.filter(no_id).select(F.col("id"), F.explode(F.array_repeat(F.lit("missing document id"), F.col("n").cast("int"))).alias("error"))
    named_parts = merged.filter(~no_id)
    facts = _facts(named_parts, dup, require_start, max_bytes)
    documents = _joined(named_parts, facts)
    whole = F.col("error").isNull()

    def if_whole(col: Column) -> Column:
        return F.when(whole, col)

    payload = if_whole(F.col("payload"))
    out = documents.select(
        F.col("id").alias(id_col),
        *[F.col("first")[f"c{i}"].alias(c) for i, c in enumerate(kept)],
        payload.alias(bin_col),
        if_whole(F.col("n_pos")).alias("blob_parts"),
        if_whole(F.sequence("low", "high")).alias("blob_sequence"),
        if_whole(F.col("low")).alias("blob_seq_min"),
        if_whole(F.col("high")).alias("blob_seq_max"),
        F.octet_length(payload).alias("compressed_len"),
        head_hex(payload).alias("compressed_head_hex"),
        "error",
    )
    return out.unionByName(nameless.select(F.col("id").alias(id_col), "error"), allowMissingColumns=True)


def assemble_blobs(df: DataFrame, id_col: str = "id", **options: object) -> tuple[DataFrame, DataFrame]:
    """(assembled documents, failed ones with ``error``); see ``assemble_documents``."""
    documents = assemble_documents(df, id_col, **options)
    failed = documents.filter(F.col("error").isNotNull()).select(named(id_col), "error")
    return documents.filter(F.col("error").isNull()).drop("error"), failed


def _parts(df: DataFrame, id_col: str, seq_col: str, bin_col: str, ordinal_col: str, kept: list[str], encoding: str) -> DataFrame:
    """Working columns, payloads decoded; other columns travel in the struct ``rest``."""
    seq = named(seq_col) if seq_col in df.columns else F.lit(None).cast("bigint")
    rest = [named(c).alias(f"c{i}") for i, c in enumerate(kept)] or [F.lit(None).cast("string").alias("c0")]
    stored = named(bin_col)
    text = stored.cast("string")
    parts = df.select(
        named(id_col).alias("id"),
        seq.isNotNull().alias("has_seq"),
        seq.try_cast("bigint").alias("seq"),
        named(ordinal_col).cast("bigint").alias("ordinal"),
        (stored.isNull() | (F.octet_length(stored) == 0)).alias("missing"),
        (F.when(is_strict_base64(text), decode_base64(text)) if encoding == "base64" else stored.cast("binary")).alias("bytes"),
        F.struct(*rest).alias("rest"),
    )
    # Parts without a number are told apart by their ordinal.
    return parts.withColumn("pos", F.coalesce("seq", "ordinal")).withColumn("bad", F.col("bytes").isNull() & ~F.col("missing"))


def _merge_copies(parts: DataFrame, dup: str) -> DataFrame:
    """One row per document and position, copies merged map-side; ``n`` counts them.

    A missing payload among the copies has to stay visible: it fails the document.
    """
    pick = F.max_by if dup == KEEP_LAST else F.min_by
    order = F.struct(F.col("ordinal"), F.col("bytes"))
    return parts.groupBy("id", "has_seq", "seq", "pos").agg(
        pick(F.struct("bytes", "bad"), order).alias("part"),
        F.min_by("rest", order).alias("rest"),
        F.min("ordinal").alias("ordinal"),
        F.count("*").alias("n"),
        F.bool_or("missing").alias("missing"),
    ).select("id", "has_seq", "seq", "pos", "ordinal", "n", "missing", "rest", F.col("part")["bytes"].alias("bytes"), F.col("part")["bad"].alias("bad"))


def _facts(parts: DataFrame, dup: str, require_start: tuple[int, ...] | None, max_bytes: int) -> DataFrame:
    """id, first, low, high, n_pos and error of each document; no payload is shuffled."""
    size = F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("bigint")
    grouped = parts.withColumn("size", size).groupBy("id").agg(
        F.min_by("rest", "ordinal").alias("first"),
        F.min("pos").alias("pos_low"),
        F.max("pos").alias("pos_high"),
        F.count("*").alias("n_pos"),
        F.sum("size").alias("n_bytes"),
        F.count_if("has_seq").alias("n_with_seq"),
        F.count_if(F.col("has_seq") & F.col("seq").isNull()).alias("n_bad_seq"),
        F.count_if("missing").alias("n_missing"),
        F.count_if("bad").alias("n_bad"),
        F.count_if(F.col("has_seq") & (F.col("n") > 1)).alias("n_twice"),
        F.count_if(~F.col("has_seq") & (F.col("n") > 1)).alias("n_same_ordinal"),
    )
    none_have = F.col("n_with_seq") == 0
    low = F.when(none_have, F.lit(0).cast("bigint")).otherwise(F.col("pos_low"))
    high = F.when(none_have, F.col("n_pos") - 1).otherwise(F.col("pos_high"))
    error = (
        F.when(~none_have & (F.col("n_with_seq") < F.col("n_pos")), "sequence number on some parts only")
        .when(F.col("n_missing") > 0, "missing payload in a part")
        .when(F.col("n_bad_seq") > 0, "sequence number is not a whole number")
        .when(F.col("n_same_ordinal") > 0, "ordinal of a part without sequence number comes twice")
    )
    if dup == FAIL:
        error = error.when(F.col("n_twice") > 0, "duplicate sequence number")
    error = error.when(~none_have & (F.col("pos_high") - F.col("pos_low") + 1 > F.col("n_pos")), "sequence gap")
    if require_start is not None:
        error = error.when(~none_have & ~F.col("pos_low").isin(*require_start), "sequence does not start where it should")
    error = error.when(F.col("n_bad") > 0, "invalid base64 in a part")
    error = error.when(F.col("n_bytes") > max_bytes, F.format_string("%d parts and %d bytes do not fit one cell", "n_pos", "n_bytes"))
    return grouped.select("id", "first", low.alias("low"), high.alias("high"), "n_pos", error.alias("error"))


def _joined(parts: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts`` with the ``payload`` of the documents that have no error.

    Facts and parts meet in one exchange by document, sorted by place, facts first;
    what is joined is written out as soon as the next document begins.
    """
    failed = facts.filter(F.col("error").isNotNull()).select("id")
    good = parts.join(failed, "id", "left_anti").select("id", "pos", "bytes")
    heads = facts.select("id", F.lit(0).alias("kind"), F.struct("first", "low", "high", "n_pos", "error").alias("fact"))
    rows = heads.unionByName(good.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # By a hash of the id: both sides of the union are partitioned by the id already, and
    # an exchange by the id would be left out, though adaptive reads move either side's rows.
    met = rows.repartition(F.xxhash64("id")).sortWithinPartitions("id", "kind", "pos").select("id", "kind", "fact", "bytes")
    schema = T.StructType([met.schema["id"], met.schema["fact"], T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[pa.RecordBatch] = []
        payloads: list[bytes | None] = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*table.columns, pa.array(payloads, pa.binary())], names=schema.names)

        for batch in batches:
            kinds = batch.column(1).to_pylist()
            for i, kind in enumerate(kinds):
                if kind == 1:
                    held.append(batch.column(3)[i].as_py())
                    continue
                if heads:
                    payloads.append(b"".join(held))
                    size += len(payloads[-1])
                    held = []
                if size >= OUT_BYTES or len(payloads) >= OUT_ROWS:
                    yield out()
                    heads, payloads, size = [], [], 0
                heads.append(batch.slice(i, 1).select([0, 2]))
        if heads:
            payloads.append(b"".join(held))
            yield out()

    return met.mapInArrow(run, schema).select("id", "fact.*", "payload")


def resolve_documents(df: DataFrame, bin_col: str = "binarydoc", lzw_label: str = "cerner_lzw") -> DataFrame:
    """Documents with their payload in ``bin_col``; ``error`` says what kept others from one.

    An embedded PDF is taken first, then an embedded RTF; both by byte search in
    native expressions.  Only payloads that hold neither go to Python, where they
    are LZW-decoded and searched again; what holds neither then is the decoded
    payload itself.  An unterminated stream is noted before decoding and an error
    after it.  An ``error`` that the input has already stays.
    """
    own = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    df = df.select(*only(df, [c for c in df.columns if c != "error"]), own.alias("_error"))
    others = only(df, [c for c in df.columns if c != bin_col])
    searched = _search(df.select(*others, named(bin_col).alias("_raw")), others, "_raw")
    embedded = F.coalesce("_pdf", "_rtf")
    note = F.concat_ws(
        "; ",
        F.when(F.col("_pdf_open"), "pdf: stream has no end marker"),
        F.when(F.col("_rtf_open"), "rtf: stream has no end marker"),
    )
    found = searched.select(
        *others,
        embedded.alias("_payload"),
        F.when(F.col("_pdf").isNotNull(), "embedded_pdf").when(F.col("_rtf").isNotNull(), "embedded_rtf").alias("_source"),
        F.when(embedded.isNull(), F.nullif(note, F.lit(""))).alias("embedded_payload_extract_error"),
        F.when(embedded.isNull(), F.col("_raw")).alias("_packed"),
    )
    found = found.withColumn("_lzw", unpacked(F.col("_packed")))
    lzw, is_lzw = F.col("_lzw"), F.col("_source").isNull()
    label = F.when(lzw["kind"] == "", lzw_label).otherwise(F.concat(F.lit(lzw_label + "_"), lzw["kind"]))
    error = F.when(is_lzw, F.when(F.col("_packed").isNull(), "missing payload").otherwise(lzw["error"]))
    return found.select(
        *others[:-1],  # without the error so far
        F.coalesce("_payload", lzw["payload"]).alias(bin_col),
        F.coalesce("_source", label).alias("blob_payload_source"),
        is_lzw.alias("is_lzw_compressed"),
        lzw["decompressed_len"].alias("decompressed_len"),
        lzw["decompressed_head_hex"].alias("decompressed_head_hex"),
        F.col("embedded_payload_extract_error"),
        F.coalesce("_error", error).alias("error"),
    )


def resolve_payload(df: DataFrame, bin_col: str = "binarydoc", lzw_label: str = "cerner_lzw") -> tuple[DataFrame, DataFrame]:
    """(documents with their payload, failed ones with ``error``); see ``resolve_documents``."""
    documents = resolve_documents(df, bin_col, lzw_label)
    kept = [c for c in df.columns if c not in (bin_col, "error")]
    failed = documents.filter(F.col("error").isNotNull())
    return (
        documents.filter(F.col("error").isNull()).drop("error"),
        failed.select(*only(failed, kept), "embedded_payload_extract_error", "error"),
    )


def _search(df: DataFrame, keep: list, col: str) -> DataFrame:
    """Add the PDF and RTF streams inside a payload, one projection per step.

    Each step's columns are used several times by the next; as separate
    projections they are computed once and the generated code stays small.
    """
    clean = F.col("_clean")
    pdf0, pdf1 = stream_marks(clean, *PDF)
    rtf0, rtf1 = stream_marks(clean, *RTF)
    marked = df.select(*keep, col, strip_markers(named(col)).alias("_clean")).select(
        *keep, col, "_clean", pdf0.alias("_p0"), pdf1.alias("_p1"), rtf0.alias("_r0"), rtf1.alias("_r1")
    )
    pdf, pdf_open = cut_stream(clean, F.col("_p0"), F.col("_p1"), PDF[1])
    rtf, rtf_open = cut_stream(clean, F.col("_r0"), F.col("_r1"), RTF[1])
    return marked.select(
        *keep, col, pdf.alias("_pdf"), pdf_open.alias("_pdf_open"), rtf.alias("_rtf"), rtf_open.alias("_rtf_open")
    )


def encode_payload(df: DataFrame, bin_col: str = "binarydoc", mode: str = "base64") -> DataFrame:
    """The payload as one-line base64, or as text with bad bytes replaced."""
    raw = named(bin_col)
    if mode == "base64":
        shown = base64_text(raw)
    elif mode == "raw":
        shown = F.make_valid_utf8(raw.cast("string"))
    else:
        raise ValueError(f"mode must be 'base64' or 'raw', not {mode!r}")
    return df.withColumn(bin_col, shown)
