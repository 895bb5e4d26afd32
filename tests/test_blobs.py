from __future__ import annotations

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.operators import assemble_blobs, encode_payload, resolve_payload
from chartloom.operators.lzw import lzw_decode, unpack
from workload.assembly import lzw_encode

SCHEMA = "id string, blob_sequence_num string, binarydoc string, ordinal long, note string"


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def run(spark, rows, **options):
    good, failed = assemble_blobs(spark.createDataFrame(rows, SCHEMA), **options)
    return {r.id: r for r in good.collect()}, {r.id: r.error for r in failed.collect()}


ROWS = [
    ("one", "5", b64(b"only"), 1, "n"),
    ("two", "2", b64(b"world"), 3, "late"),
    ("two", "1", b64(b"hello "), 2, "first"),
    ("gap", "1", b64(b"a"), 4, None), ("gap", "3", b64(b"b"), 5, None),
    ("dup", "1", b64(b"old"), 6, None), ("dup", "1", b64(b"new"), 7, None), ("dup", "2", b64(b"!"), 8, None),
    ("mixed", "1", b64(b"a"), 9, None), ("mixed", None, b64(b"b"), 10, None),
    ("none", None, b64(b"x"), 21, None), ("none", None, b64(b"y"), 20, None),
    ("bad", "1", "YW=j", 11, None), ("space", "1", "YW Jj", 12, None),
    ("null", "1", None, 13, None), ("empty", "1", "", 14, None),
    ("word", "one", b64(b"a"), 15, None),
    ("", "1", b64(b"a"), 16, None), (None, "1", b64(b"a"), 17, None),
]


def test_assembly(spark):
    good, failed = run(spark, ROWS)
    assert {k: bytes(r.binarydoc) for k, r in good.items()} == {"one": b"only", "two": b"hello world", "none": b"yx"}
    two = good["two"]
    assert (two.blob_parts, two.blob_sequence, two.blob_seq_min, two.blob_seq_max) == (2, [1, 2], 1, 2)
    assert (two.compressed_len, two.compressed_head_hex, two.note) == (11, b"hello world".hex(), "first")
    assert good["none"].blob_sequence == [0, 1]
    assert failed == {
        "gap": "sequence gap", "dup": "duplicate sequence number", "mixed": "sequence number on some parts only",
        "bad": "invalid base64 in a part", "space": "invalid base64 in a part", "null": "missing payload in a part",
        "empty": "missing payload in a part", "word": "sequence number is not a whole number",
        "": "missing document id", None: "missing document id",
    }


@pytest.mark.parametrize(("dup", "expected"), [("keep_first", b"old!"), ("keep_last", b"new!")])
def test_duplicates_kept(spark, dup, expected):
    good, failed = run(spark, ROWS, dup=dup)
    assert bytes(good["dup"].binarydoc) == expected and "dup" not in failed


def test_start_rule(spark):
    good, failed = run(spark, ROWS, require_start=(0, 1))
    assert failed["one"] == "sequence does not start where it should" and "two" in good


@pytest.mark.parametrize("dup", ["fail", "keep_first", "keep_last"])
def test_hot_part(spark, dup):
    """A document with a third of all rows: copies of one part, merged before the shuffle."""
    rows = [("hot", "1", b64(b"a%d" % i), i, None) for i in range(400)] + [("hot", "2", b64(b"z"), 1000, None)]
    rows += [(f"d{i}", "1", b64(b"x"), 2000 + i, None) for i in range(800)]
    good, failed = run(spark, rows, dup=dup)
    assert len(good) == 800 + (dup != "fail")
    if dup == "fail":
        assert failed == {"hot": "duplicate sequence number"}
    else:
        assert bytes(good["hot"].binarydoc) == (b"a0z" if dup == "keep_first" else b"a399z")
        assert good["hot"].blob_parts == 2 and failed == {}


@pytest.mark.parametrize("dup", ["fail", "keep_last"])
def test_many_parts(spark, dup):
    """A document of very many parts is whole, byte for byte, and so are its checks."""
    n = 10_000
    parts = [("many", str(i), b64(b"%d," % i), i, "first" if i == 5 else None) for i in range(5, n)]
    gap = [("gap", str(i), b64(b"x"), i, None) for i in range(9000) if i != 4500]
    free = [("free", None, b64(b"%d," % i), 7 * i, None) for i in range(9000)]
    bad = [("bad", str(i), b64(b"x") if i != 8000 else "*", i, None) for i in range(9000)]
    small = [(f"d{i}", "1", b64(b"x"), i, None) for i in range(100)]
    good, failed = run(spark, parts + gap + free + bad + small, dup=dup)
    assert bytes(good["many"].binarydoc) == b"".join(b"%d," % i for i in range(5, n)) and good["many"].note == "first"
    assert (good["many"].blob_parts, good["many"].blob_seq_min, good["many"].blob_seq_max) == (n - 5, 5, n - 1)
    assert bytes(good["free"].binarydoc) == b"".join(b"%d," % i for i in range(9000)) and good["free"].blob_seq_max == 8999
    assert failed == {"gap": "sequence gap", "bad": "invalid base64 in a part"} and len(good) == 102


def test_document_beyond_a_cell(spark):
    rows = [("big", str(i), b64(b"abc"), i, None) for i in range(60)] + [("ok", "1", b64(b"abc"), 100, None)]
    good, failed = run(spark, rows, max_bytes=100)
    assert list(good) == ["ok"] and failed == {"big": "60 parts and 180 bytes do not fit one cell"}


def test_parts_without_numbers_are_never_merged(spark):
    """Parts in record order are told apart by their ordinal; a repeated ordinal is a failure, not a copy."""
    rows = [("free", None, b64(x), i, None) for i, x in enumerate((b"AA", b"AA", b"BB"))]
    rows += [("same", None, b64(b"AA"), 1, None), ("same", None, b64(b"BB"), 1, None), ("same", None, b64(b"CC"), 2, None)]
    for dup in ("fail", "keep_first", "keep_last"):
        good, failed = run(spark, rows, dup=dup)
        assert bytes(good["free"].binarydoc) == b"AAAABB"
        assert failed == {"same": "ordinal of a part without sequence number comes twice"}


def test_parts_are_read_once(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "parts"))
    good, failed = assemble_blobs(spark.read.parquet(str(tmp_path / "parts")))
    assert good.inputFiles() == [] == failed.inputFiles()


def test_split_and_assemble_is_identity(spark):
    rng = random.Random(1)
    docs = {f"d{i}": rng.randbytes(rng.randint(1, 3000)) for i in range(50)}
    rows, n = [], 0
    for key, data in docs.items():
        size = rng.randint(1, 700)
        for i, at in enumerate(range(0, len(data), size)):
            rows.append((key, str(i), b64(data[at : at + size]), n, None))
            n += 1
    rng.shuffle(rows)
    good, failed = run(spark, rows)
    assert failed == {} and {k: bytes(r.binarydoc) for k, r in good.items()} == docs


def test_raw_parts(spark):
    rows = spark.createDataFrame([("a", 1, bytearray(b"\xff\x00"), 1), ("a", 2, bytearray(b"\x01"), 2)], "id string, blob_sequence_num int, binarydoc binary, ordinal long")
    good, _ = assemble_blobs(rows, encoding="raw")
    assert bytes(good.first().binarydoc) == b"\xff\x00\x01"


def test_options_are_checked(spark):
    with pytest.raises(ValueError, match="dup"):
        assemble_blobs(spark.createDataFrame(ROWS, SCHEMA), dup="keep")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400))
def test_lzw_round_trip(data):
    assert lzw_decode(lzw_encode(data)) == data


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 4))
def test_lzw_round_trip_through_every_width(seed, letters):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"abcd"[:letters]) for _ in range(60_000)) + rng.randbytes(20_000)
    assert lzw_decode(lzw_encode(data)) == data


def test_lzw_restart_begins_on_the_byte_it_ended_in():
    # 256 as nine bits is 10000000 0.......; the next code starts at that second byte.
    restart = bytes([0x80])
    assert lzw_decode(restart + lzw_encode(b"abc")) == b"abc"


@pytest.mark.parametrize("data", [b"", b"\x01", b"\xff\xff\xff", lzw_encode(b"hello")[:-2]])
def test_lzw_errors(data):
    with pytest.raises(ValueError):
        lzw_decode(data)


def test_unpack_finds_the_stream():
    assert unpack(lzw_encode(b"ocf_blob\x00x%PDF-a%%EOF y"))["payload"] == b"%PDF-a%%EOF"
    assert unpack(lzw_encode(b"%PDF-a"))["error"] == "decoded pdf stream has no end marker"
    assert unpack(lzw_encode(b""))["error"] == "LZW decode gave an empty payload"


def test_payload_choice(spark):
    plain = b"plain text"
    rows = {
        "pdf": b"ocf_blob\x00..%PDF-1%%EOF..", "rtf": b"{\\rtf x}", "both": b"{\\rtf}%PDF-1%%EOF",
        "open": b"%PDF-1 {\\rtf x}", "lzw": lzw_encode(plain), "lzw_pdf": lzw_encode(b"%PDF-1%%EOF."),
        "lzw_rtf": lzw_encode(b"..{\\rtf x}"), "broken": b"%PDF- junk", "null": None, "lzw_open": lzw_encode(b"{\\rtf "),
    }
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows.items()], "id string, binarydoc binary")
    good, failed = resolve_payload(df)
    got = {r.id: (bytes(r.binarydoc), r.blob_payload_source, r.is_lzw_compressed) for r in good.collect()}
    assert got == {
        "pdf": (b"%PDF-1%%EOF", "embedded_pdf", False), "rtf": (b"{\\rtf x}", "embedded_rtf", False),
        "both": (b"%PDF-1%%EOF", "embedded_pdf", False), "open": (b"{\\rtf x}", "embedded_rtf", False),
        "lzw": (plain, "cerner_lzw", True), "lzw_pdf": (b"%PDF-1%%EOF", "cerner_lzw_pdf", True),
        "lzw_rtf": (b"{\\rtf x}", "cerner_lzw_rtf", True),
    }
    bad = {r.id: r for r in failed.collect()}
    assert set(bad) == {"broken", "null", "lzw_open"}
    assert bad["broken"].embedded_payload_extract_error == "pdf: stream has no end marker"
    assert bad["null"].error == "missing payload" and bad["lzw_open"].error == "decoded rtf stream has no end marker"
    lzw = good.filter("id = 'lzw'").first()
    assert (lzw.decompressed_len, lzw.decompressed_head_hex) == (len(plain), plain.hex())
    text = {r.id: r.binarydoc for r in encode_payload(good, mode="raw").collect()}
    assert text["lzw"] == "plain text"


def test_good_and_failed_decode_once_each(spark):
    """The filter on the error must not sit below the decode step a second time."""
    good, _ = resolve_payload(spark.createDataFrame([("a", bytearray(b"x"))], "id string, binarydoc binary"))
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
