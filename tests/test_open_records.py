"""Records whose keys aren't known beforehand: responses as VARIANT, ids in JSON lists."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chartloom.operators import (
    deid_records,
    has_field,
    json_records,
    nlp_records,
    ocr_records,
    open_fields,
    parse_deid,
    read_open_records,
)


def records(spark, values):
    texts = [(json.dumps(v),) for v in values]
    return spark.createDataFrame(texts, "j string").select(F.parse_json("j").alias("record"))


def plain(df):
    return sorted((json.loads(r["j"]) for r in df.select(F.to_json("record").alias("j")).collect()), key=lambda r: json.dumps(r, sort_keys=True))


def ordered(values):
    return sorted(values, key=lambda r: json.dumps(r, sort_keys=True))


def test_read_open_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n  \n[{"b": null}, 3]\nbroken{\n[]\n', encoding="utf-8")
    (tmp_path / "b.txt").write_text("no\n", encoding="utf-8")
    good, failed = read_open_records(spark, str(tmp_path), "*.json")
    assert plain(good) == ordered([{"a": 1}, {"b": None}, 3])
    assert [(r["text"], r["error"]) for r in failed.collect()] == [("broken{", "not JSON")]
    fields = open_fields(good.filter(has_field(F.col("record"), "b") | has_field(F.col("record"), "a")), {"a": "int", "b": "string"})
    assert {tuple(r) for r in fields.collect()} == {(1, None), (None, None)}


def ocr_brute(response):
    result = response.get("result", {})
    out = {"metadata": result.get("metadata", {}), "text": result.get("text", ""), "success": result.get("success", False)}
    out["timestamp"] = result.get("timestamp")
    return out | result.get("footer", {})


def test_ocr_records(spark):
    fine = [
        {"result": {"text": "t", "metadata": {"p": 1}, "success": True, "timestamp": "x", "footer": {"timestamp": None, "new": [1, {"a": None}]}}},
        {"result": {"text": None, "footer": {"other": 1.5}}}, {"result": {}}, {}, {"result": {"text": "a", "footer": {"text": "raw", "it's": 1}}},
    ]
    bad = [{"result": None}, {"result": [1]}, {"result": {"footer": None}}, {"result": {"footer": "x"}}]
    good, failed = ocr_records(records(spark, fine + bad))
    assert plain(good) == ordered([ocr_brute(r) for r in fine])
    assert plain(failed) == ordered(bad)
    assert {r["error"] for r in failed.collect()} == {"the result is no object", "the footer is no object"}
    assert "body" in plain(ocr_records(records(spark, [{}]), "body")[0])[0]


def first_marks(document):
    held = document.get("annotations", [])
    return (held[0] if held else {}) if isinstance(held, list) else held or {}


def test_nlp_records(spark):
    mark = {"id": 1, "cui": "C1", "timestamp": "mark"}
    fine = [
        {"model_info": {"m": 1}, "result": [
            {"timestamp": "t", "annotations": [{"0": mark, "1": {"id": 2}}], "footer": {"_id": "d1", "cui": None}},
            {"annotations": [{}], "footer": None}, {"annotations": []}, {"annotations": None}, {"text": "x"},
        ]},
        {"result": {"annotations": {"7": {"x": [1]}}, "footer": {"_id": None, "k": 1}}}, {"other": 1}, {"result": []},
        {"result": [{"annotations": [{"a": {}}]}]},
    ]
    want = []
    for response in fine:
        result = response.get("result", [])
        for document in result if isinstance(result, list) else [result]:
            for name, data in first_marks(document).items():
                out = {"service_model": response.get("model_info", {}), "timestamp": document.get("timestamp")} | data | document.get("footer", {})
                if document.get("footer", {}).get("_id") is not None:
                    out["annotation_id"] = f"{document['footer']['_id']}_{name}"
                want.append(out)
    broken = [{"annotations": [{"0": 5}], "footer": {}}, {"annotations": [{"0": {}}], "footer": 3}, {"annotations": "x"}, "doc"]
    good, failed = nlp_records(records(spark, [*fine, {"result": broken}]))
    assert plain(good) == ordered(want)
    assert plain(failed) == ordered(broken)


@pytest.mark.parametrize("empty", ["drop", "restore"])
@pytest.mark.parametrize("bare", ["drop", "restore"])
def test_deid_records(spark, empty, bare):
    marks = [{"0": {"id": 0}}]
    documents = [
        {"success": True, "text": "clean", "annotations": marks, "timestamp": "t", "footer": {"_id": 1, "source": None}},
        {"success": True, "text": "clean", "annotations": marks, "footer": {"_id": 2, "text": "raw", "timestamp": "f"}},
        {"success": True, "text": "clean", "annotations": marks, "timestamp": "t", "footer": {"_id": 3, "text": None}},
        {"success": True, "text": " \n", "annotations": marks, "footer": {"_id": 4}}, {"success": True, "text": None, "footer": None},
        {"success": True, "text": "none found", "annotations": [], "footer": {"_id": 5, "text": "raw"}},
        {"success": True, "annotations": [], "footer": {"_id": 6}}, {"success": False, "text": "", "annotations": [], "footer": {}},
        {"success": False, "text": "", "annotations": marks, "footer": {"_id": 7}}, {"success": "true", "text": "", "annotations": marks, "footer": {}},
        {"success": True, "text": "x", "annotations": [{}], "footer": [1]}, {"success": True, "text": "", "annotations": []},
        {"success": True, "text": 5, "annotations": marks},
    ]
    want = []
    for d in documents:
        held, footer, done = first_marks(d), d.get("footer", {}), d.get("success") is True
        fits = footer if isinstance(footer, dict) else {} if footer is None else {"footer": footer}
        if done and "text" in d and (d["text"] is None or isinstance(d["text"], str) and not d["text"].strip()):
            if empty == "restore":
                want.append(dict(fits) | {"text": d["text"], "service_status": "skipped_empty_text"})
        elif not held:
            if done and "text" in d and bare == "restore":
                want.append(dict(fits) | {"text": d["text"], "service_status": "no_annotations"})
        else:
            want.append({"service_model": {"v": 1}, "timestamp": d.get("timestamp"), "text": d.get("text", ""), "annotations": held} | fits)
    bad = [{"success": True, "text": "x", "annotations": marks, "footer": 9}, 7]
    df = records(spark, [{"model_info": {"v": 1}, "result": documents + bad}])
    good, failed = deid_records(df, empty_text=empty, no_annotations=bare)
    assert plain(good) == ordered(want)
    assert plain(failed) == ordered(bad)
    renamed = plain(deid_records(df, "clean", "raw", False)[0])
    assert {r["clean"] for r in renamed if "clean" in r and r["annotations"] == {}} >= {"clean"}


def test_parse_deid_keeps_texts_of_uneven_footers(spark, tmp_path):
    lines = [
        {"result": {"success": True, "text": "clean A", "timestamp": "t", "annotations": [{"0": {"id": 0}}], "footer": {"_id": "a", "timestamp": "src"}}},
        {"result": {"success": True, "text": "clean B", "timestamp": "t", "annotations": [{"0": {"id": 0}}], "footer": {"_id": "b"}}},
        {"result": {"success": True, "text": "clean C", "timestamp": "t", "annotations": [{"0": {"id": 0}}], "footer": {"_id": "c", "text": "raw C"}}},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)), encoding="utf-8")
    shape = "result struct<success: boolean, text: string, timestamp: string, annotations: array<map<string, struct<id: int>>>, "
    shape += "footer: struct<_id: string, timestamp: string, text: string>>"
    df = spark.read.schema(shape).json(str(tmp_path))
    got = parse_deid(df, info_col=None).select("_id", "timestamp", "text").collect()
    assert sorted(tuple(r) for r in got) == [("a", "src", "clean A"), ("b", "t", "clean B"), ("c", "t", "raw C")]


def test_ids_in_lists_of_any_kind(spark):
    texts = {
        1: '[{"id":"11"},{"id":12}]', 2: '{"records":[{"id":"13"},7,{"id":14},null,"{\\"id\\": 5}",[{"id":6}],{"id":null},{"x":1}]}',
        3: "broken[", 4: None, 5: "{}", 6: '{"records": 5}', 7: '[{"id":14.0},{"id":true},{"id":" 15 "},{"id":{"id":1}},{"id":"1.0"}]',
        8: '  [ {"id": 123456789012345678901234567890} ]', 9: '[{"id":1,"id":2},"x",{"id":3}]', 10: "[]", 11: '"[]"', 12: "3",
    }
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "at int, j string, position int")
    got = {}
    for r in json_records(df.drop("position"), "j", "id", ["at"]).collect():
        got.setdefault(r["at"], []).append((r["position"], r["id"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(0, "11"), (1, "12")], 2: [(0, "13"), (2, "14"), (6, None), (7, None)],
        7: [(0, "14.0"), (1, "true"), (2, " 15 "), (3, '{"id":1}'), (4, "1.0")],
        8: [(0, "123456789012345678901234567890")], 9: [(0, "2"), (2, "3")],
    }
