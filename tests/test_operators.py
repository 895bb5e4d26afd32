from __future__ import annotations

import datetime as dt
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chartloom.operators import (
    PatientColumns,
    add_geolocation,
    affirmed,
    apply_text_model,
    assign_location,
    binary_to_base64,
    cast_dates_by_name,
    cui_patient_facts,
    enrich,
    entity_views,
    explode_records,
    extract_payload,
    fetch_by_ids,
    flatten_annotations,
    hits_to_request,
    ids_csv,
    incremental,
    join_metadata,
    json_records,
    limit_batch,
    map_codes,
    map_schema,
    match_text,
    merge_counts,
    not_yet_processed,
    parse_deid,
    parse_nlp,
    parse_ocr,
    patient_dims,
    patient_encounters,
    patient_table,
    request_batches,
    split_affirmed,
    terms,
    to_attributes,
    to_nested_map,
    to_nlp_request,
    to_ocr_request,
    union_all,
    unidentified_documents,
    unwrap_hit,
    upsert,
    with_metrics,
    with_ordinal,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def from_json(spark, records, schema):
    """Rows as a JSON reader gives them."""
    text = spark.createDataFrame([(json.dumps(r),) for r in records], "j string")
    return text.select(F.from_json("j", schema).alias("r")).select("r.*")


def test_mapper_edges(spark):
    df = from_json(
        spark,
        [{"a": 0, "b": False, "c": "", "d": [], "e": {"x": 1}, "l": [{"label": "q", "valueNum": 0, "comment": False}, {"label": ""}, None]}],
        "a int, b boolean, c string, d array<string>, e struct<x:int>, l array<struct<label:string,valueNum:int,comment:boolean>>",
    )
    out = rows(map_schema(df, {
        "text": ["a", "b", "c", "d", "e", "l", "gone"], "none": ["c", "gone"], "first": ["c", "b", "a"],
        "c2": "c", "b": "a", "e.y": "x", "e.z": None, "gone.x": "y", "a2": "missing", "ph": None,
    }, first_non_empty=["first"]))[0]
    assert out["text"] == "0\nFalse\nq: 0 | False" and out["none"] is None and out["first"] == "False"
    # a is renamed to b; the record's own b comes later and stays, as it is not mapped.
    assert "a" not in out and out["b"] is False and out["c2"] == "" and "c" not in out
    assert out["e"] == {"y": 1, "z": None} and "a2" not in out and out["ph"] is None and "gone" not in out


def test_mapper_identity_and_drop(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert rows(map_schema(df, {})) == rows(df)
    assert rows(map_schema(df, {"c": "b"}, preserve_unmapped=False)) == [{"c": "x"}]


def test_mapper_nested_list_keeps_nulls(spark):
    df = from_json(spark, [{"l": [{"p": 1}, None]}, {}], "l array<struct<p:int>>")
    assert rows(map_schema(df, {"l.q": "p"})) == [{"l": [{"q": 1}, None]}, {"l": None}]


def test_mapper_is_one_projection(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet")
    mapped = map_schema(df, {"id": "c_custkey", "t": ["c_name", "c_mktsegment"]}, preserve_unmapped=False)
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1 and "c_acctbal" not in mapped._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_requests(spark):
    df = spark.createDataFrame([(1, "a", bytearray(b"xy")), (2, None, None)], "id int, text string, bin binary")
    assert [(r["text"], r["footer"]["id"]) for r in rows(to_nlp_request(df))] == [("a", 1), ("", 2)]
    assert [r["binary_data"] for r in rows(to_ocr_request(df, "bin"))] == ["eHk=", None]
    assert binary_to_base64(df, "bin").columns == ["bin", "id", "text"]
    with pytest.raises(ValueError, match="raw"):
        to_ocr_request(df, "text")
    attributes = rows(to_attributes(df, "text"))[0]
    assert attributes["attributes"] == {"id": "1", "bin": "xy"} and attributes["attribute_list"] == ["id", "text", "bin"]


def test_request_bodies(spark):
    df = to_nlp_request(spark.createDataFrame([(i, "t" * i) for i in range(1, 6)], "id int, text string").coalesce(1))
    bodies = [json.loads(r["request"])["content"] for r in rows(request_batches(df, batch_size=2))]
    assert [len(b) if isinstance(b, list) else 1 for b in bodies] == [2, 2, 1]
    assert bodies[2] == {"text": "ttttt", "footer": {"id": 5}}
    assert len(rows(request_batches(df, batch_size=100, max_chars=40))) == 5


def test_hits(spark):
    df = from_json(
        spark,
        [{"_id": "1", "fields": {"text": "ab", "n": 1}}, {"_id": "2", "_source": {"text": "c"}}, {"_id": "3", "text": "top"}, {"_id": "4"}],
        "_id string, text string, fields struct<text:string,n:int>, _source struct<text:string>",
    )
    assert [(r["_id"], r["text"], r["n"]) for r in rows(unwrap_hit(df))] == [("1", "ab", 1), ("2", "c", None), ("3", "top", None), ("4", None, None)]
    ok, invalid = hits_to_request(df)
    assert [(r["id"], r["footer"]["_id"], r["text"]) for r in rows(ok)] == [("1", "1", "ab"), ("3", "3", "top")]
    assert [r["_id"] for r in rows(invalid)] == ["2", "4"]


def test_extract_payload(spark):
    df = spark.createDataFrame([("YWI=", 1, None), ("%%", 2, "x")], "b string, n int, s string")
    assert rows(extract_payload(df, "b")) == [{"content": bytearray(b"ab"), "n": "1", "s": None}, {"content": None, "n": "2", "s": "x"}]


def test_ocr_response(spark):
    schema = "result struct<metadata:map<string,string>,text:string,success:boolean,timestamp:string,footer:struct<id:int,success:string>>"
    df = from_json(spark, [{"result": {"text": "t", "success": True, "footer": {"id": 1, "success": "mine"}}}, {"result": {}}, {}], schema)
    got = rows(parse_ocr(df))
    assert got[0] == {"metadata": {}, "text": "t", "success": "mine", "timestamp": None, "id": 1}
    assert got[1]["text"] == "" and got[2]["metadata"] == {}


NLP = """model_info struct<name:string>, result array<struct<text:string,success:boolean,timestamp:string,
  annotations:array<map<string,struct<cui:string,doc:string>>>,footer:struct<_id:int,doc:string>>>"""


def answer(i, text="t", success=True, annotations=True, footer=True):
    found = [{"7": {"cui": "c", "doc": "ann"}}] if annotations else []
    return {"text": text, "success": success, "timestamp": "ts", "annotations": found, "footer": {"_id": i, "doc": "foot"} if footer else None}


def test_annotations(spark):
    df = from_json(spark, [{"model_info": {"name": "m"}, "result": [answer(1), answer(2, annotations=False), answer(3, footer=False)]}, {"result": []}], NLP)
    got = rows(parse_nlp(df))
    assert [(r["cui"], r["doc"], r["annotation_id"]) for r in got] == [("c", "foot", "1_7"), ("c", "ann", None)]
    assert got[0]["service_model"] == {"name": "m"}


def test_deid_order_of_checks(spark):
    df = from_json(spark, [{"result": [
        answer(1, "  "), answer(2, "  ", success=False), answer(3, annotations=False), answer(4, annotations=False, success=False),
        answer(5, None, success=False), answer(6), answer(7, "", annotations=False),
    ]}], NLP)
    assert {r["_id"]: (r["text"], r["service_status"]) for r in rows(parse_deid(df))} == {
        2: ("  ", None), 3: ("t", "no_annotations"), 5: ("", None), 6: ("t", None)}
    strict = rows(parse_deid(df, empty_text="restore", no_annotations="drop", keep_annotations=False))
    assert {r["_id"]: (r["text"], r["service_status"], r["annotations"]) for r in strict} == {
        1: ("  ", "skipped_empty_text", None), 2: ("  ", None, {}), 5: ("", None, {}), 6: ("t", None, {}), 7: ("", "skipped_empty_text", None)}
    with pytest.raises(ValueError, match="empty_text"):
        parse_deid(df, empty_text="keep")


def test_flatten(spark):
    schema = """model_info struct<service_model:string,service_version:string>,
      result array<struct<timestamp:string,footer:struct<docid:int,dept:string>,annotations:map<string,struct<id:int,cui:string,types:array<string>>>>>"""
    df = from_json(spark, [{"model_info": {"service_model": "m", "service_version": "1"}, "result": [
        {"timestamp": "ts", "footer": {"docid": 5, "dept": "x"}, "annotations": {"a": {"id": 9, "cui": "c", "types": ["t1"]}, "b": {"id": 8, "cui": "d", "types": ["t2"]}, "e": {"id": 7, "cui": "f"}}},
        {"footer": {"docid": 6}, "annotations": {}}]}], schema)
    got = rows(flatten_annotations(df, "keyed", "docid", ["dept"], ignore_types=["t2"]))
    assert {r["document_annotation_id"]: (r["nlp.cui"], r["meta.docid"], r["meta.dept"], r["timestamp"]) for r in got} == {
        "5_9": ("c", 5, "x", "ts"), "5_7": ("f", 5, "x", "ts")}


META = "struct<Subject:struct<value:string>,Presence:struct<value:string>,Time:struct<value:string>>"


def mention(doc, cui, ts, subject="Patient", presence="True", time="Past", **drop):
    meta = {"Subject": {"value": subject}, "Presence": {"value": presence}, "Time": {"value": time}}
    return {"docid": doc, "cui": cui, "timestamp": ts, "meta_anns": {k: v for k, v in meta.items() if k not in drop}}


def mentions(spark, records):
    return from_json(spark, records, f"docid long, cui string, timestamp string, meta_anns {META}")


def test_affirmed(spark):
    df = mentions(spark, [
        mention(1, "a", None), mention(2, "a", None, subject="Family"), mention(3, "a", None, presence="False"),
        mention(4, "a", None, time="Future"), mention(5, "a", None, time=None), mention(6, "a", None, Time=0),
        mention(7, "a", None, Subject=0), mention(8, "a", None, subject="Family", Presence=0), mention(9, "a", None, Presence=0)])
    good, failed = split_affirmed(df)
    assert [r["docid"] for r in rows(good)] == [1, 5] and {r["docid"]: r["error"] for r in rows(failed)} == {
        6: "no Time", 7: "no Subject", 9: "no Presence"}
    assert rows(affirmed(df)) == rows(good)


def test_facts(spark):
    df = mentions(spark, [
        mention(1, "a", "2020-01-01T00:00:00.5"), mention(1, "a", "2020-01-01T00:00:01.5+00:00"), mention(2, "a", None),
        mention(3, "a", "2019-12-31T23:00:00-01:00"), mention(4, "b", "1970-01-01T00:00:00"), mention(9, "a", "2000-01-01T00:00:00")])
    known = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "q"), ("4", "p")], "docid string, patient string")
    got = {(r["cui"], r["patient"]): (r["n"], r["first_seen"]) for r in rows(cui_patient_facts(affirmed(df), known))}
    assert got == {("a", "p"): (3, 1577836800), ("a", "q"): (1, 1577836800), ("b", "p"): (1, None)}


def test_merge_and_nest(spark):
    a = spark.createDataFrame([("c", "p", 1, 50), ("c", "q", 2, None)], "cui string, patient string, n long, first_seen long")
    merged = merge_counts([a, a.withColumn("first_seen", F.lit(7).cast("long"))])
    assert {r["patient"]: (r["n"], r["first_seen"]) for r in rows(merged)} == {"p": (2, 7), "q": (4, 7)}
    assert rows(to_nested_map(merged, "cui", "patient", "n")) == [{"cui": "c", "part": 0, "entries": {"p": 2, "q": 4}}]


def test_hot_key_of_a_map_is_split(spark):
    """A concept with most of the patients takes several bounded rows that add up to all of them."""
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))).alias("cui"), F.col("id").alias("patient"), F.lit(1).alias("n"))
    got = rows(to_nested_map(df, "cui", "patient", "n", max_entries=500))
    hot = [r for r in got if r["cui"] == "hot"]
    assert len(hot) == 8 and max(len(r["entries"]) for r in got) < 700
    assert set().union(*[r["entries"] for r in hot]) == {str(i) for i in range(4000)} and sum(len(r["entries"]) for r in hot) == 4000


PATIENTS = [
    (' "p1" ', "white-british", "1", "1950-02-01", None, 10, 1),
    ("p1", "other_x", "f", "bad", None, 11, 2),
    ("p2", None, None, None, "2000-01-01", 12, 3),
    ("p3", "x", "m", "1900-01-01", "null", 13, 4),
    ("p3", "x", "m", "1900-01-01", "", 13, 3),
    (None, "x", "m", "1900-01-01", "", 14, 5),
]
PATIENT_SCHEMA = "patient string, ethnicity string, gender string, birthdate string, deathdate string, docid int, ordinal int"
AS_OF = "TIMESTAMP_NTZ'2024-06-30 00:00:00'"


def test_patients(spark):
    df = spark.createDataFrame(PATIENTS, PATIENT_SCHEMA)
    got = {r["patient"]: r for r in rows(patient_table(df, F.expr(AS_OF), age_limit=True))}
    assert set(got) == {"p1", "p2", "p3"}
    # The last record gives the labels, the last readable one the dates.
    assert (got["p1"]["sex"], got["p1"]["ethnicity"], got["p1"]["dob"], got["p1"]["age"]) == ("Female", "Other X", 19500201000000, 74)
    assert (got["p2"]["ethnicity"], got["p2"]["dob"], got["p2"]["dod"], got["p2"]["age"]) == ("Unknown", 0, 20000101000000, None)
    assert (got["p3"]["age"], got["p3"]["dod"]) == (-1, 20240630000000)
    dims = patient_dims(df, F.expr(AS_OF))
    assert {r["docid"]: r["patient"] for r in rows(dims["doc2ptt"])} == {"10": "p1", "12": "p2", "13": "p3"}


def test_patient_columns_that_are_absent(spark):
    df = spark.createDataFrame([("p", 0, 1)], "patient string, birthdate long, ordinal int")
    got = rows(patient_table(df, F.expr(AS_OF)))[0]
    assert (got["ethnicity"], got["sex"], got["dob"], got["age"]) == ("Other", "Unknown", 19700101000000, 54)
    assert rows(patient_dims(df, F.expr(AS_OF))["doc2ptt"]) == []
    backup = df.withColumn("died", F.lit("1980-01-01"))
    assert rows(patient_table(backup, F.expr(AS_OF), PatientColumns(death_backup="died")))[0]["dod"] == 19800101000000
    both = backup.withColumn("deathdate", F.lit(None).cast("string"))
    cols = PatientColumns(death_backup="died")
    assert rows(patient_table(both, F.expr(AS_OF), cols))[0]["dod"] == 0
    assert rows(patient_table(both, F.expr(AS_OF), cols, death_when="null"))[0]["dod"] == 19800101000000


def test_geolocation(spark):
    places = spark.createDataFrame([("AB1", "1", "2", 1), ("AB1", "3", "4", 2), ("CD2", "NULL", "1", 3)], "postcode_no_space string, latitude string, longitude string, ordinal int")
    df = spark.createDataFrame([(1, "A B1"), (2, "ab1"), (3, "AB1\t"), (4, "ZZ"), (5, None), (6, ""), (7, "CD 2")], "id int, address_postcode string")
    got = {r["id"]: (r["address_geolocation"], r["geolocation_error"]) for r in rows(add_geolocation(df, places))}
    assert got == {1: ("3.0,4.0", False), 2: (None, False), 3: (None, False), 4: (None, False), 5: (None, False), 6: (None, False), 7: (None, True)}


def test_lookup_beyond_broadcast_gives_the_same(spark):
    """With broadcasting off and a third of the rows without a key, rows are spread and none is lost."""
    codes = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("code"), F.col("id").cast("string").alias("label"))
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), (F.col("id") % 2000).cast("string"))).alias("v"))
    small = sorted((r["id"], r["v"]) for r in rows(map_codes(df, "v", codes)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = map_codes(df, "v", codes)
        assert sorted((r["id"], r["v"]) for r in rows(shuffled)) == small
        assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(small) == 9000 and dict(small)[1] == "1" and dict(small)[3] is None


def test_views(spark):
    patients = spark.createDataFrame([(1, "x")], "id int, last string")
    visits = spark.createDataFrame([(5, 1, "c"), (6, 2, "d")], "id int, patient int, code string")
    view = patient_encounters(patients, visits)
    assert rows(view) == [{"patient_id": 1, "patient_last_name": "x", "encounter_id": 5, "encounter_code": "c"}]
    drugs = spark.createDataFrame([(9, "t", 1, 5, "m"), (8, "t", 1, 6, "n")], "cid int, created string, patient int, encounter int, code string")
    got = rows(entity_views(view, {"medications": drugs})["medications_view"])
    assert len(got) == 1 and (got[0]["cog_pk"], got[0]["cog_timestamp"], got[0]["code"], got[0]["encounter_code"]) == (9, "t", "m", "c")
    with pytest.raises(ValueError, match="entity"):
        entity_views(view, {"pets": drugs})


def test_ledger(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    done = spark.createDataFrame([("1",), ("1",), (None,)], "document_id string")
    assert {r["id"] for r in rows(not_yet_processed(df, done, "id"))} == {2, None}
    target = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "k string, v int, at int")
    updates = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, at int")
    assert {r["k"]: r["v"] for r in rows(upsert(target, updates, "k", "at"))} == {"a": 1, "b": 3, "c": 4}
    undated = spark.createDataFrame([("d", 5, None), ("e", 6, None), ("e", 7, 1)], "k string, v int, at int")
    assert {r["k"]: r["v"] for r in rows(upsert(target, undated, "k", "at"))} == {"a": 1, "b": 1, "d": 5, "e": 7}
    again = upsert(upsert(target, updates, "k", "at"), updates, "k", "at")
    assert sorted(map(str, rows(again))) == sorted(map(str, rows(upsert(target, updates, "k", "at"))))
    assert [r["v"] for r in rows(fetch_by_ids(updates, spark.createDataFrame([("b",), ("b",)], "k string"), "k", "at"))] == [2, 3]
    new, mark = incremental(updates, "at", 1)
    assert [r["v"] for r in rows(new)] == [3] and rows(mark) == [{"high_water": 2}]
    assert rows(incremental(updates, "at", 9)[1]) == [{"high_water": 9}]
    assert [r["v"] for r in rows(limit_batch(updates, 2, ["v"]))] == [2, 3]


def test_incremental_filter_reaches_the_scan(spark, sf):
    new, _ = incremental(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", 100)
    assert "GreaterThan(o_orderkey,100)" in new._jdf.queryExecution().executedPlan().toString()


def test_ids_csv(spark):
    df = spark.createDataFrame([(" 7 ", 1), ("x", 2), (None, 3), ("5", 4), ("7", 5), ("1.0", 6)], "id string, pos int")
    assert rows(ids_csv(df, "id", "pos")) == [{"slice": 0, "ids_csv": "7,5,7", "ids_count": 3, "ids_len": 5}]
    assert rows(ids_csv(df, "id", "pos", distinct=True))[0]["ids_csv"] == "7,5"
    assert sorted((r["slice"], r["ids_csv"]) for r in rows(ids_csv(df, "id", "pos", max_ids=2))) == [(0, "7,5"), (1, "7")]
    sparse = spark.range(5).select(F.col("id").cast("string").alias("id"), (F.col("id") * 1_000_000).alias("pos"))
    assert [r["ids_csv"] for r in rows(ids_csv(sparse, "id", "pos"))] == ["0,1,2,3,4"]
    text = spark.createDataFrame([(1, '{"records": [{"id": 7}, {"x": 1}, {"id": "5"}]}'), (2, "broken"), (3, None), (4, "{}")], "at int, j string")
    from_json_text = json_records(text, "j", "id", ["at"])
    assert rows(ids_csv(from_json_text, "id", ["at", "position"])) == [{"slice": 0, "ids_csv": "7,5", "ids_count": 2, "ids_len": 3}]


def test_terms_and_metrics(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string")
    assert rows(terms(df, "k", 1)) == [{"key": "b", "doc_count": 2}]
    counted, seen = with_metrics(df, "m", F.col("k").isNull())
    assert counted.count() == 4 and seen.get == {"record_count": 4, "error_count": 1}


def test_ordinals_and_records(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("t").alias("tie"))
    got = {r["v"]: r["ordinal"] for r in rows(with_ordinal(df, ["v"], partitions=7))}
    assert got == {i: i for i in range(5000)}
    tied = [r["ordinal"] for r in rows(with_ordinal(df, ["tie"], partitions=7))]
    assert sorted(tied) == list(range(5000))
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("y",)], "z string")
    assert rows(union_all([a, b])) == [{"x": 1, "z": None}, {"x": None, "z": "y"}]
    nested = spark.createDataFrame([([(1, "a"), (2, "b")],)], "r array<struct<i:int,s:string>>")
    assert rows(explode_records(nested, "r")) == [{"i": 1, "s": "a"}, {"i": 2, "s": "b"}]


def test_metadata_join(spark):
    files = spark.createDataFrame([("/a", "x.y.pdf", bytearray(b"1")), ("/b", "x.y.pdf", bytearray(b"2")), ("/a", "lone.pdf", bytearray(b"3"))], "folder string, file_name string, content binary")
    meta = spark.createDataFrame([("/a", "x.y", None), ("/a", "nofile", "m")], "folder string, file_name_id_no_ext string, note string")
    assert rows(join_metadata(files, meta)) == [{"folder": "/a", "file_name_id_no_ext": "x.y", "note": "", "binarydoc": "MQ==", "text": ""}]


def test_dates_by_name(spark):
    df = spark.createDataFrame([("2020-01-02", "2020-01-02", 5)], "visit_Date string, note string, created int")
    out = cast_dates_by_name(df)
    assert dict(out.dtypes) == {"visit_Date": "timestamp_ntz", "note": "string", "created": "int"}
    assert rows(out)[0]["visit_Date"] == dt.datetime(2020, 1, 2)


def make_failing_client():
    def call(batch):
        if (batch["text"] == "bad").any():
            raise ValueError("no")
        return batch.assign(size=batch["text"].str.len())[["size"]]

    return call


def test_enrich_isolates_the_bad_record(spark):
    df = spark.createDataFrame([(i, "bad" if i == 4 else "ok") for i in range(10)], "id int, text string").coalesce(1)
    got = {r["id"]: (r["size"], r["error"]) for r in rows(enrich(df, make_failing_client, ["text"], "size long", batch_size=5, retries=0))}
    assert got[4] == (None, "ValueError: no") and all(v == (2, None) for k, v in got.items() if k != 4) and len(got) == 10
    with pytest.raises(ValueError, match="in the input already"):
        enrich(df, make_failing_client, ["text"], "id int")


def make_upper():
    return lambda texts: "[" + texts.str.upper() + "]"


def make_odd_client():
    def call(batch):
        odd = batch["id"] == 3
        return batch.assign(size=["long" if o else 1 for o in odd])[["size"]]

    return call


def test_enrich_leaves_other_columns_alone(spark):
    """64-bit ids beside a null stay what they are, and an answer of the wrong type fails alone."""
    big = 9007199254740993
    df = spark.createDataFrame([(3, big, (big + 2,)), (4, None, (None,)), (5, big + 4, None)], "id long, key long, footer struct<n:long>").coalesce(1)
    got = {r["id"]: r for r in rows(enrich(df, make_odd_client, ["id", "key"], "size long", retries=0))}
    assert [got[i]["key"] for i in (3, 4, 5)] == [big, None, big + 4] and got[3]["footer"] == {"n": big + 2}
    assert [got[i]["size"] for i in (3, 4, 5)] == [None, 1, 1] and "ArrowInvalid" in got[3]["error"] and got[4]["error"] is None


def make_moody():
    def model(texts):
        if texts.str.contains("bad").any():
            raise ValueError("no")
        return texts.str.upper()

    return model


def test_text_model_fails_alone(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "a bad one"), (3, None), (4, "x")], "id int, t string").coalesce(1)
    got = {r["id"]: (r["t"], r["error"]) for r in rows(apply_text_model(df, "t", make_moody, char_limit=100))}
    assert got == {1: ("ABC", None), 2: (None, "ValueError: no"), 3: (None, None), 4: ("X", None)}


def test_codes_of_any_type_and_phrases(spark):
    codes = spark.createDataFrame([(1, "one"), (2, "two")], "code int, label string")
    df = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "id int, v int")
    assert {r["id"]: r["v"] for r in rows(map_codes(df, "v", codes))} == {1: "one", 2: "3", 3: None}
    texts = spark.createDataFrame([(1, "An X-ray of the chest."), (2, "Chest pain!"), (3, "pain in the chest"), (4, None)], "id int, t string")
    found = lambda *terms, **how: [r["id"] for r in rows(match_text(texts, "t", terms, **how).orderBy("id"))]
    assert found("x-ray") == [1] and found("chest pain") == [2] and found("pain", "ray") == [1, 2, 3] and found("pain", "chest", every=True) == [2, 3]
    assert found("-") == [] and found("hest") == []


def test_ties_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("k", i, 1) for i in range(50)], "k string, v int, at int")
    target = df.limit(0)
    assert len({rows(upsert(target, df.repartition(n), "k", "at"))[0]["v"] for n in (1, 2, 3, 5, 7)}) == 1


def test_a_mark_ends_the_rows(spark):
    rows_, mark = incremental(spark.createDataFrame([(1,), (5,), (None,)], "at int"), "at")
    assert sorted(r["at"] or 0 for r in rows(rows_)) == [0, 1, 5] and rows(mark) == [{"high_water": 5}]
    assert "<= 5" in rows_._jdf.queryExecution().optimizedPlan().toString()


def test_last_file_of_a_stem(spark):
    files = spark.createDataFrame([("/a", "x.pdf", bytearray(b"1")), ("/a", "x.txt", bytearray(b"2"))], "folder string, file_name string, content binary")
    meta = spark.createDataFrame([("/a", "x", "n")], "folder string, file_name_id_no_ext string, note string")
    assert [r["binarydoc"] for r in rows(join_metadata(files, meta))] == ["Mg=="]


def test_meta_annotations_that_no_record_has(spark):
    df = spark.createDataFrame([(1, (("Patient",), ("True",)))], "id int, meta_anns struct<Subject:struct<value:string>,Presence:struct<value:string>>")
    good, failed = split_affirmed(df)
    assert rows(good) == [] and [r["error"] for r in rows(failed)] == ["no Time"]


def test_one_line_per_key_or_an_error(spark, monkeypatch):
    from chartloom.operators import cohort

    df = spark.createDataFrame([("c", str(i), i) for i in range(6)], "c string, p string, n int")
    assert len(rows(to_nested_map(df, "c", "p", "n"))) == 1
    monkeypatch.setattr(cohort, "MAP_ENTRIES", 5)
    with pytest.raises(Exception, match="6 entries do not fit one map"):
        rows(to_nested_map(df, "c", "p", "n"))


def test_documents_without_an_id(spark):
    schema = """model_info struct<service_model:string,service_version:string>,
      result array<struct<timestamp:string,footer:struct<docid:int>,annotations:map<string,struct<id:int>>>>"""
    df = from_json(spark, [{"result": [{"footer": {"docid": 5}, "annotations": {"a": {"id": 9}}}, {"footer": {}, "annotations": {"b": {"id": 8}}}, {}]}], schema)
    assert len(rows(flatten_annotations(df, "keyed", "docid"))) == 1
    assert [r["error"] for r in rows(unidentified_documents(df, "keyed", "docid"))] == ["annotated document without an id"] * 2


def test_all_date_notations(spark):
    day, noon = dt.datetime(2020, 12, 31), dt.datetime(2020, 12, 31, 10, 15, 16)
    texts = {
        "2020-12-31 10:15:16": noon, "2020-12-31": day, "20201231": day, "2020-12-31T10": noon.replace(minute=0, second=0),
        "2020-12-31T10:15": noon.replace(second=0), "2020-12-31T10:15:16": noon, "10:15:16.123Z": dt.datetime(1970, 1, 1, 10, 15, 16, 123000),
        "10:15": dt.datetime(1970, 1, 1, 10, 15), "2020/12/31": day, "31/12/2020": day, "31/12/2020 10:15": noon.replace(second=0),
        "2020-12-31T10:15:16.123Z": noon.replace(microsecond=123000), "2020-12-31T10:15:16.123+01:00": noon.replace(hour=9, microsecond=123000),
        "T10:15:16.123Z": dt.datetime(1970, 1, 1, 10, 15, 16, 123000), "2020-12-31T10:15:16.123": noon.replace(microsecond=123000),
        "101516.123Z": dt.datetime(1970, 1, 1, 10, 15, 16, 123000), "101516Z": dt.datetime(1970, 1, 1, 10, 15, 16),
        "T101516.123Z": dt.datetime(1970, 1, 1, 10, 15, 16, 123000), "10:15:16": dt.datetime(1970, 1, 1, 10, 15, 16),
        "10:15.16": dt.datetime(1970, 1, 1, 10, 15, 16), "10:15.16+0000": dt.datetime(1970, 1, 1, 10, 15, 16), "86400000": dt.datetime(1970, 1, 2),
        "1609409716123": noon.replace(microsecond=123000), "soon": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "visit_date string")
    got = rows(df.select("visit_date", F.col("visit_date").alias("t")).transform(lambda d: cast_dates_by_name(d)))
    assert {r["t"]: r["visit_date"] for r in got} == texts


def test_text_model_keeps_the_tail(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "ab"), (3, None), (4, ""), (5, "abc"), (6, "abcd")], "id int, t string")
    got = {r["id"]: r["t"] for r in rows(apply_text_model(df, "t", make_upper, char_limit=3))}
    assert got == {1: "[ABC][DEF][GH]", 2: "[AB]", 3: None, 4: "[]", 5: "[ABC]", 6: "[ABC][D]"}
    assert apply_text_model(df, "absent", make_upper) is df


def test_locations_are_stable_and_inside(spark):
    boxes = [("n", 10.0, 11.0, -1.0, 0.0), ("s", 50.0, 52.0, 5.0, 9.0)]
    df = spark.range(200)
    first, again = (rows(assign_location(df, "id", boxes, 3)) for _ in range(2))
    assert first == again and {r["area"] for r in first} == {"n", "s"}
    for r in first:
        lon, lat = map(float, r["gen_location"][7:-1].split())
        _, a, b, c, d = boxes[r["area"] == "s"]
        assert a <= lat <= b and c <= lon <= d


def test_names_with_dots(spark):
    """Stored annotations carry dotted names; a dot is part of the name."""
    df = mentions(spark, [mention(1, "a", "2020-01-01T00:00:00")]).toDF("meta.docid", "nlp.cui", "time.stamp", "nlp.meta_anns")
    known = spark.createDataFrame([("1", "p")], ["meta.docid", "patient.id"])
    facts = cui_patient_facts(affirmed(df, "nlp.meta_anns"), known, "nlp.cui", "meta.docid", "time.stamp", "patient.id")
    assert rows(facts) == [{"cui": "a", "patient": "p", "n": 1, "first_seen": 1577836800}]
    dotted = spark.createDataFrame([("k", "x", 1)], ["a.id", "b.text", "at.n"])
    assert rows(to_nlp_request(dotted, "b.text")) == [{"text": "x", "footer": {"a.id": "k", "at.n": 1}}]
    assert rows(upsert(dotted, dotted.withColumn("at.n", F.lit(2).cast("long")), "a.id", "at.n"))[0]["at.n"] == 2
    assert rows(to_nested_map(dotted, "a.id", "b.text", "at.n"))[0]["entries"] == {"x": 1}
    assert rows(terms(dotted, "a.id")) == [{"key": "k", "doc_count": 1}]
    assert rows(map_schema(dotted, {"t": ["a.id", "b.text"]}, preserve_unmapped=False)) == [{"t": "k\nx"}]
    assert rows(fetch_by_ids(dotted, dotted, "a.id", "at.n")) == rows(dotted)
    assert rows(incremental(dotted, "at.n", 0)[1]) == [{"high_water": 1}]
