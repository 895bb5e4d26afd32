"""Files of JSON read by byte ranges against the reader that takes them whole."""

from __future__ import annotations

import json
import random

import pytest

from chartloom.sources import read_json_ranges, read_json_records
from chartloom.sources.json_ranges import lex

SCHEMA = "id bigint, text string, tags array<string>, inner struct<a: string, b: array<struct<c: string>>>"

NASTY = ['"', "\\", '\\"', "}", "{", "[", "]", "},{", '"}', "é", "日本", "\n", "\t", " ", "a", "\\\\", '\\\\"', " ", "x" * 40, "/", "null"]


def nasty(rng):
    return "".join(rng.choice(NASTY) for _ in range(rng.randrange(12)))


def record(rng, i):
    out = {"id": i, "text": nasty(rng)}
    if rng.random() < 0.5:
        out["tags"] = [nasty(rng) for _ in range(rng.randrange(4))]
    if rng.random() < 0.5:
        out["inner"] = {"a": nasty(rng), "b": [{"c": nasty(rng)} for _ in range(rng.randrange(3))]}
    return out


@pytest.fixture
def small_ranges(spark):
    """Ranges of some hundred bytes, so that small files have many."""
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def both(spark, folder):
    whole, bad = read_json_records(spark, str(folder), SCHEMA)
    ranges, failed = read_json_ranges(spark, str(folder), SCHEMA)
    key = lambda r: json.dumps(r.asDict(True), sort_keys=True)
    name = lambda r: r["path"].rsplit("/", 1)[1]
    return sorted(map(key, ranges.collect())), sorted(map(key, whole.collect())), sorted(map(name, failed.collect())), sorted(map(name, bad.collect()))


def test_same_rows_as_the_whole_reader(spark, tmp_path, small_ranges):
    rng = random.Random(11)
    for f in range(6):
        rows = [record(rng, 1000 * f + i) for i in range(rng.choice([0, 1, 40]))]
        text = json.dumps(rows, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        (tmp_path / f"f{f}.json").write_text(rng.choice(["", " \n"]) + text + rng.choice(["", "\n "]), encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps(record(rng, 7)) + "\n", encoding="utf-8")
    (tmp_path / "bare.json").write_text('{"id":1,"inner":{"a":"x"}}', encoding="utf-8")
    (tmp_path / "mark.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([record(rng, i) for i in range(5)]).encode())
    long = [{"id": 1, "text": "no brace " * 400}, {"id": 2, "text": "}" * 900}, {"id": 3, "text": '\\"' * 500}]
    (tmp_path / "long.json").write_text(json.dumps(long), encoding="utf-8")
    ranges, whole, failed, bad = both(spark, tmp_path)
    assert len(whole) > 40 and ranges == whole
    assert failed == bad == []
    lines = spark.read.option("lineSep", "}").text(str(tmp_path / "long.json"))
    assert lines.select("_metadata.file_block_start").distinct().count() > 5


DAMAGED = {
    "cut": '[{"id":1},{"id":2},{"id":3', "cut_after": '[{"id":1},{"id":2}', "cut_string": '[{"id":1},{"text":"abc', "text": "[{\"id\":1},{\"id\":\"many\"},{\"id\":3}]",
    "number": '[{"id":1},7,{"id":2}]', "comma": '[{"id":1} {"id":2}]', "colon": '[{"id":1},{"id" 2}]', "quote": '[{"id":1,"text":"a"b"},{"id":2}]',
    "swapped": '[{"id":1,"tags":["a"}],{"id":2}]', "word": "hello", "nested": '[[{"id":1}]]',
}


def test_damaged_files_fail_alike(spark, tmp_path, small_ranges):
    fine = [{"id": 90 + i, "text": "}{" * 30} for i in range(5)]
    (tmp_path / "fine.json").write_text(json.dumps(fine), encoding="utf-8")
    for name, text in DAMAGED.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    ranges, whole, failed, bad = both(spark, tmp_path)
    assert failed == sorted(f"{n}.json" for n in DAMAGED)
    assert set(bad) <= set(failed)
    assert ranges == sorted(json.dumps(r | {"tags": None, "inner": None}, sort_keys=True) for r in fine)


def test_elements_for_themselves(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text('[{"id":1},{"id":"many","text":"t"},{"id":3},null,{"id":4}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"id":5} {"id":6}', encoding="utf-8")
    (tmp_path / "c.json").write_text("  ", encoding="utf-8")
    (tmp_path / "d.json").write_text("", encoding="utf-8")
    (tmp_path / "e.json").write_text("[ ]", encoding="utf-8")
    (tmp_path / "f.json").write_text('[{"id":7}', encoding="utf-8")
    good, failed = read_json_ranges(spark, str(tmp_path), SCHEMA, whole_files=False)
    assert sorted(r["id"] for r in good.collect()) == [1, 3, 5]
    got = sorted((r["path"][-6:], r["text"], r["record"]) for r in failed.collect())
    assert got == [("a.json", ',null,{"id":4}', '{"id":4}'), ("a.json", ',{"id":"many","text":"t"}', '{"text":"t"}'), ("b.json", '{"id":6}', '{"id":6}'), ("f.json", None, None)]
    good, failed = read_json_ranges(spark, str(tmp_path), SCHEMA, name_glob="[ce].json")
    assert good.count() == failed.count() == 0


def test_lex():
    data = b'{"a\\"}": [1, "\\\\"], "b": "\\\\\\"]"}'
    places, step, odd, quotes = lex(data)
    outside = "".join(chr(data[p]) for p in places[odd == 0])
    assert outside == "{[]}" and quotes % 2 == 0
    assert step[odd == 0].sum() == 0
