from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chartloom.functions import (
    age_and_death,
    annotation_id,
    base64_text,
    clean_id,
    decode_base64,
    extract_pdf,
    extract_rtf,
    file_stem,
    geo_string,
    is_blank,
    is_numeric_id,
    is_strict_base64,
    norm_gender,
    norm_label,
    parse_date,
    parse_first,
    pseudo_id,
    python_float_text,
    scrub,
    strip_markers,
    title_case,
    ts_to_int,
    wkt_point,
)
from chartloom.operators.casts import DATE_FORMATS
from chartloom.sources import decode_with_fallback


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(make(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_float_text_is_python_repr(spark):
    values = [0.0, -0.0002, 0.00051, 1e-5, 0.1, 1 / 3, 9999999.0, 1e7, 12345678.9, 1.5e15, 1e16, 2.5e300, -1e-300, 123456789012345.6]
    assert column(spark, values, "double", python_float_text) == [repr(v) for v in values]
    assert column(spark, [math.nan, math.inf, -math.inf], "double", python_float_text) == ["nan", "inf", "-inf"]


def test_float_text_of_random_values(spark):
    # Up to 15 digits: beyond that the text of a double depends on the Java version.
    rng = random.Random(3)
    values = [float(f"{rng.uniform(-1, 1):.{rng.randint(1, 14)}e}") * 1.0 for _ in range(500)]
    values += [float(f"{rng.uniform(-1, 1):.12e}") * 10 ** rng.randint(-12, 15) for _ in range(500)]
    values = [float(f"{v:.14g}") for v in values]
    assert column(spark, values, "double", python_float_text) == [repr(v) for v in values]


def test_title_case_follows_python(spark):
    values = ["they're o'neil 3rd x-ray", "ÉCOLE élan", "", "a", "white british/other (mixed)"]
    assert column(spark, values, "string", title_case) == [v.title() for v in values]


def test_scrub_order_matters(spark):
    values = ["NMUH report", "GMC: 1234567", "100F and 99m", "a PEF Barnet", "see https://www.royalfree.nhs.uk/x?y z", None]
    got = column(spark, values, "string", scrub)
    assert got == [" report", "GC: 1234567", " and 99", "a ABCD100 rnet", "see  z", None]


def test_ids(spark):
    assert column(spark, [' "a\'1"\t\n', None, "x"], "string", clean_id) == ["a1", None, "x"]
    assert column(spark, [" 12 ", "1x", "", None, "٣"], "string", is_numeric_id) == [True, False, False, None, False]
    assert column(spark, ["d", None], "string", lambda c: annotation_id(c, F.lit(3))) == ["d_3", None]
    first, again = (column(spark, ["d"], "string", pseudo_id) for _ in range(2))
    assert first == again and len(first[0]) == 32


def test_labels(spark):
    assert column(spark, ["White_British-X", None], "string", norm_label) == ["white british x", "unknown"]
    assert column(spark, ["M", "2", "female", "x", None], "string", norm_gender) == ["Male", "Female", "Female", "Unknown", "Unknown"]


def test_dates(spark):
    assert column(spark, ["2020-02-03", "bad", "null", "", None], "string", lambda c: ts_to_int(parse_date(c))) == [
        20200203000000, 0, 0, 0, 0]
    assert column(spark, ["null", "bad"], "string", lambda c: ts_to_int(parse_date(c, epoch_default=True))) == [19700101000000, 0]
    assert column(spark, [1580688000000, -1], "bigint", lambda c: ts_to_int(parse_date(c, epoch_millis=True))) == [
        20200203000000, 19691231235959]
    texts = ["2020-02-03 04:05:06", "2020-02-03", "20200203", "2020-02-03T04:05:06", "1580702706000", "x", None]
    at = dt.datetime(2020, 2, 3, 4, 5, 6)
    day = dt.datetime(2020, 2, 3)
    assert column(spark, texts, "string", lambda c: parse_first(c, DATE_FORMATS)) == [at, day, day, at, at, None, None]


def test_age(spark):
    def age(limit):
        birth = F.col("b").cast("timestamp_ntz")
        death = F.col("d").cast("timestamp_ntz")
        return age_and_death(birth, death, F.lit("2024-06-30").cast("timestamp_ntz"), limit)

    rows = spark.createDataFrame([("1920-01-01", None), ("1920-01-01", "1990-01-01"), ("2000-05-05", None), (None, None)], "b string, d string")
    assert [r[0] for r in rows.select(age(False)[0]).collect()] == [104, 70, 24, None]
    limited = rows.select(*[c.alias(n) for c, n in zip(age(True), ("age", "dod"))]).collect()
    assert [r.age for r in limited] == [-1, 70, 24, None]
    assert limited[0].dod == dt.datetime(2024, 6, 30)


def test_geo(spark):
    rows = spark.createDataFrame([(" 51.50 ", "-0.000125"), ("NULL", "1"), (None, "1")], "a string, o string")
    assert [r[0] for r in rows.select(geo_string(F.col("a"), F.col("o"))).collect()] == ["51.5,-0.000125", None, None]
    assert rows.limit(1).select(wkt_point(F.lit(1.5), F.lit(-2.0))).first()[0] == "POINT (1.5 -2.0)"


def test_base64(spark):
    data = bytes(range(256)) * 3
    encoded = column(spark, [data], "binary", base64_text)[0]
    assert "\n" not in encoded and column(spark, [encoded], "string", decode_base64) == [bytearray(data)]
    assert column(spark, ["YWJj", "YWI=", "YW=j", "YWJ", "YW Jj", "", "YWJj\n"], "string", is_strict_base64) == [
        True, True, False, False, False, True, False]


PAYLOADS = [
    b"\xff\x00xx%PDF-1.4 \xe9%%EOF mid %%EOFz",
    b"%%EOF %PDF- open",
    b"nothing",
    b"\xe9{\\rtf1 a} \xff}x",
    b"} {\\rtf open",
    b"%PDF-\nocf_blob\x00 x%%EOF",
    b"%PD\xffocr_blob\x00F-%%EOF",
]


def _python_cut(data, start, end):
    for marker in (b"\nocf_blob\x00", b"ocf_blob\x00", b"ocr_blob\x00"):
        data = data.replace(marker, b"")
    begin, stop = data.find(start), data.rfind(end)
    if begin < 0:
        return None, False
    return (None, True) if stop < begin else (bytearray(data[begin : stop + len(end)]), False)


@pytest.mark.parametrize(("make", "start", "end"), [(extract_pdf, b"%PDF-", b"%%EOF"), (extract_rtf, b"{\\rtf", b"}")])
def test_embedded_streams(spark, make, start, end):
    found = column(spark, PAYLOADS, "binary", lambda c: make(c)[0])
    still_open = column(spark, PAYLOADS, "binary", lambda c: make(c)[1])
    assert list(zip(found, still_open)) == [_python_cut(p, start, end) for p in PAYLOADS]


def test_embedded_pdf_in_random_bytes(spark):
    rng = random.Random(5)
    pieces = [b"%PDF-", b"%%EOF", b"\xff", b"\xe2\x82", b"ocf_blob\x00", b"a", b"\n"]
    payloads = [b"".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(1000)]
    found = column(spark, payloads, "binary", lambda c: extract_pdf(c)[0])
    assert found == [_python_cut(p, b"%PDF-", b"%%EOF")[0] for p in payloads]


def test_markers_null_and_text(spark):
    assert column(spark, [None, b"ocf_blob\x00a"], "binary", strip_markers) == [None, bytearray(b"a")]
    assert column(spark, ["a.b.pdf", "plain", ".x"], "string", file_stem) == ["a.b", "plain", ""]
    assert column(spark, [None, " \t\n", " ", "a"], "string", is_blank) == [True, True, True, False]


def test_charset_fallback(spark):
    values = ["é€".encode(), "é€".encode("cp1252"), b"\x81", "plain".encode()]
    assert column(spark, values, "binary", decode_with_fallback) == ["é€", "é€", None, "plain"]
    assert column(spark, [b"\xe9"], "binary", lambda c: decode_with_fallback(c, ["us-ascii", "iso-8859-1"])) == ["é"]
    every = bytes(b for b in range(256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    assert column(spark, [every], "binary", lambda c: decode_with_fallback(c, ["cp1252"])) == [every.decode("cp1252")]


def test_decimal_is_text(spark):
    from chartloom.operators import to_ndjson

    row = spark.createDataFrame(
        [(Decimal("1.50"), dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 600000), bytearray(b"ab"), None, "é", [dt.date(2020, 1, 2)])],
        "a decimal(5,2), b date, c timestamp_ntz, d binary, e int, f string, g array<date>",
    )
    assert to_ndjson(row).first()[0] == (
        '{"a":"1.50","b":"2020-01-02","c":"2020-01-02T03:04:05.600000","d":"YWI=","e":null,"f":"é","g":["2020-01-02"]}'
    )
