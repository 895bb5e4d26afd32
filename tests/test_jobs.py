from __future__ import annotations

import base64
import json
import random
import sys
import time

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chartloom.functions import base64_text
from chartloom.operators import assemble_blobs, enrich
from chartloom.plans import (
    AssembleDocuments,
    Flow,
    NlpRequests,
    Param,
    SchemaMap,
    TextScrub,
    Transform,
    annotate_documents,
    build_cohort,
    split_failed,
    write_cohort,
)
from chartloom.sources import (
    POSTCODE_COLUMNS,
    decode_with_fallback,
    read_avro,
    read_csv,
    read_documents,
    read_encoded_json,
    read_high_water,
    read_json_records,
    read_ndjson,
    read_postcodes,
    write_dict_json,
    write_failures,
    write_high_water,
    write_ndjson,
    write_split,
    write_upsert,
)
from chartloom.streaming import assembly, read_batches, run_stream, run_tagged, stream_assemble_blobs, stream_documents
from test_operators import AS_OF, PATIENT_SCHEMA, PATIENTS, mention, mentions

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_json_units(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1}')
    (tmp_path / "many.json").write_text('[{"a": 2},\n {"a": 3}]')
    (tmp_path / "none.json").write_text("5")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "ann_part.json").write_text('[{"a": 9}]')
    (tmp_path / "typed.json").write_text('[{"a": 4}, {"a": "x"}, {"a": 5}]')
    good, failed = read_json_records(spark, str(tmp_path), "a int")
    assert sorted(r["a"] for r in rows(good)) == [1, 2, 3]
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in rows(failed)} == {"none.json": "5", "typed.json": '[{"a": 4}, {"a": "x"}, {"a": 5}]'}
    assert rows(read_json_records(spark, str(tmp_path), "a int", name_glob="*ann*")[0]) == [{"a": 9}]
    (tmp_path / "sub" / "l.ndjson").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in rows(read_ndjson(spark, str(tmp_path / "sub" / "l.ndjson"), "a int")[0])] == [1, 2]
    (tmp_path / "sub" / "bad.ndjson").write_text('{"a": 1}\n{"a": \n{"a": "x"}\n{"a": 4}\n')
    good, failed = read_ndjson(spark, str(tmp_path / "sub" / "bad.ndjson"), "a int")
    assert [r["a"] for r in rows(good)] == [1, 4] and sorted(r["text"] for r in rows(failed)) == ['{"a": ', '{"a": "x"}']


def test_json_in_several_charsets(spark, tmp_path):
    for name, data in (("u", '[{"a": "é"}]'.encode()), ("w", '{"a": "é€"}'.encode("cp1252")), ("x", b'{"a": "\x81"}'), ("y", b"[1")):
        (tmp_path / f"{name}.json").write_bytes(data)
    good, failed = read_encoded_json(spark, str(tmp_path), "a string")
    assert sorted(r["a"] for r in rows(good)) == ["é", "é€"]
    assert {r["path"][-6:]: r["error"] for r in rows(failed)} == {"x.json": "no charset fits", "y.json": "not JSON, or not of the schema"}


def test_text_in_any_charset(spark):
    text = "naïve café 北京 Привет"
    fits = {"utf-8": text, "utf-16": text, "utf-32": text, "gb18030": text, "koi8-r": "Привет", "cp1251": "Привет", "iso-8859-7": "Αθήνα",
            "shift_jis": "日本語", "iso-2022-jp": "日本語", "euc-kr": "한국어", "big5": "中文", "cp437": "café ▒", "mac-roman": "café", "utf-7": "é+"}
    df = spark.createDataFrame([(c, t.encode(c)) for c, t in fits.items()], "charset string, stored binary")
    read = F.coalesce(*[decode_with_fallback(F.when(F.col("charset") == c, F.col("stored")), [c]) for c in fits])
    assert {r["charset"]: r["text"] for r in df.select("charset", read.alias("text")).collect()} == fits
    odd = spark.createDataFrame([(b"\xff",), (b"\xfe\x00",), (None,), (b"",), (b"\x93\xfa\x96\x7b",), (b"caf\xe9",)], "b binary")
    read = decode_with_fallback(F.col("b"), ["us-ascii", "utf-8", "shift_jis", "cp1253"])
    assert [r["t"] for r in odd.select(read.alias("t")).collect()] == [None, "ώ\x00", None, "", "日本", "cafι"]
    with pytest.raises(LookupError):
        decode_with_fallback(F.col("b"), ["no such charset"])


def test_folders_with_odd_names(spark, tmp_path):
    for day in ("my docs/2022/08/01", "50%+é/2022/08/02"):
        folder = tmp_path / day
        folder.mkdir(parents=True)
        (folder / "a.pdf").write_bytes(day.encode())
        (folder / "metadata.csv").write_bytes("file_name_id_no_ext|dept\na|Ä\n".encode("latin-1"))
    got = rows(read_documents(spark, str(tmp_path), encoding="iso-8859-1"))
    assert sorted(base64.b64decode(r["binarydoc"]).decode() for r in got) == ["50%+é/2022/08/02", "my docs/2022/08/01"]
    assert {r["dept"] for r in got} == {"Ä"}


def test_failures_of_a_rerun(spark, tmp_path):
    df = spark.createDataFrame([("a", "e")], "k string, error string")
    for step in ("one", "two", "one"):
        write_failures(df, str(tmp_path / "f"), step)
    assert sorted(r["step"] for r in rows(spark.read.json(str(tmp_path / "f")))) == ["one", "two"]


def test_a_payload_that_decodes_to_too_much():
    from chartloom.operators.lzw import lzw_decode
    from workload.assembly import lzw_encode

    packed = lzw_encode(b"a" * 200_000)
    assert len(lzw_decode(packed)) == 200_000
    with pytest.raises(ValueError, match="more than 1000 bytes"):
        lzw_decode(packed, 1000)


def test_csv_and_postcodes(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a|b\n1|\n")
    assert rows(read_csv(spark, str(tmp_path / "m.csv"))) == [{"a": "1", "b": None}]
    (tmp_path / "p.csv").write_text(",".join(f"v{i}" for i in range(17)) + "\n" + ",".join(f"w{i}" for i in range(17)) + "\n")
    got = rows(read_postcodes(spark, str(tmp_path / "p.csv")).orderBy("ordinal"))
    assert [r["postcode_no_space"] for r in got] == ["v9", "w9"] and len(POSTCODE_COLUMNS) == 17


def test_avro_says_what_is_missing(spark, tmp_path):
    with pytest.raises(RuntimeError, match="spark-avro"):
        read_avro(spark, str(tmp_path))


@pytest.fixture
def tree(tmp_path):
    for day in ("2022/08/01", "2022/08/02", "other"):
        folder = tmp_path / day
        folder.mkdir(parents=True)
        for name in ("a", "b.c"):
            (folder / f"{name}.pdf").write_bytes(f"{day}/{name}".encode())
        (folder / "metadata.csv").write_text("file_name_id_no_ext|dept\na|x\nnofile|y\n")
    (tmp_path / "2022/08/01" / "more.csv").write_text("file_name_id_no_ext|dept\nb.c|\n")
    return tmp_path


def test_documents_with_metadata(spark, tree):
    got = rows(read_documents(spark, str(tree)))
    assert sorted((r["folder"][-10:], r["file_name_id_no_ext"], r["dept"], base64.b64decode(r["binarydoc"])) for r in got) == [
        ("2022/08/01", "a", "x", b"2022/08/01/a"), ("2022/08/01", "b.c", "", b"2022/08/01/b.c"), ("2022/08/02", "a", "x", b"2022/08/02/a")]


def test_documents_files_only_with_ledger_and_limit(spark, tree):
    got = rows(read_documents(spark, str(tree), "files_only", pseudo=True))
    assert len(got) == 4 and len({r["document_Pseudo_Id"] for r in got}) == 4 and got[0]["document_Fields_text"] == ""
    ledger = spark.createDataFrame([(f"{tree}/2022/08/01", "a")], "folder string, document_id string")
    rest = rows(read_documents(spark, str(tree), "files_only", ledger=ledger, max_files=2))
    assert [(r["folder"][-10:], r["document_Id"]) for r in rest] == [("2022/08/01", "b.c"), ("2022/08/02", "a")]
    everything = spark.createDataFrame([(r["folder"], r["document_Id"]) for r in got], "folder string, document_id string")
    assert rows(read_documents(spark, str(tree), "files_only", ledger=everything, max_files=2)) == []


def test_sinks_repeat(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "k string, v int")
    for _ in range(2):
        write_ndjson(df.orderBy("k").coalesce(1), str(tmp_path / "n"))
        write_dict_json(df, "k", "v", str(tmp_path / "d"))
    assert lines(tmp_path / "n") == [{"k": "a", "v": None}, {"k": "b", "v": 2}]
    assert lines(tmp_path / "d") == [{"a": None, "b": 2}]
    write_dict_json(spark.range(1000), "id", "id", str(tmp_path / "big"), max_entries=100)
    parts = lines(tmp_path / "big")
    assert len(parts) == 10 and {k: v for p in parts for k, v in p.items()} == {str(i): i for i in range(1000)}
    write_split(spark.range(100).coalesce(1), str(tmp_path / "s"), 30)
    assert len(list((tmp_path / "s").glob("part-*"))) == 4
    write_failures(df.withColumn("error", F.lit("e")), str(tmp_path / "f"), "step")
    assert sorted(r["record"] for r in rows(spark.read.json(str(tmp_path / "f")))) == ['{"k":"a","v":null}', '{"k":"b","v":2}']


def test_versions_and_marks(spark, tmp_path):
    first = spark.createDataFrame([("a", 1)], "k string, at int")
    first.write.parquet(str(tmp_path / "v1"))
    second = write_upsert(spark.read.parquet(str(tmp_path / "v1")), spark.createDataFrame([("a", 2), ("b", 1)], "k string, at int"), "k", "at", str(tmp_path / "v2"))
    assert {r["k"]: r["at"] for r in rows(second)} == {"a": 2, "b": 1}
    assert read_high_water(spark, str(tmp_path / "mark")) is None
    write_high_water(second.agg(F.max("at").alias("high_water")), str(tmp_path / "mark"))
    assert read_high_water(spark, str(tmp_path / "mark")) == 2


class Doubled(Transform):
    params = {"col": Param("n", required=True), "times": Param(2, allowed=(2, 3)), "loud": Param(False)}
    prepared = 0

    def prepare(self, spark):
        type(self).prepared += 1

    def apply(self, df):
        return df.withColumn(self.col, F.col(self.col) * self.times), df.filter(F.col(self.col) < 0).withColumn("error", F.lit("negative"))


def test_transform_contract(spark):
    step = Doubled(times="3", loud="true")
    assert (step.col, step.times, step.loud) == ("n", 3, True)
    for bad in ({"times": 4}, {"col": ""}, {"loud": "maybe"}, {"other": 1}):
        with pytest.raises(ValueError):
            Doubled(**bad)
    result = Flow([step, Doubled()]).run(spark.createDataFrame([(1,), (-1,)], "n int"))
    assert Doubled.prepared == 2 and [r["n"] for r in rows(result.good)] == [6, -6]
    assert sorted((r["step"], r["record"]) for r in rows(result.failures)) == [("Doubled", '{"n":-1}'), ("Doubled", '{"n":-3}')]


@pytest.mark.parametrize("cut", [False, True])
def test_document_flow(spark, cut):
    parts = spark.createDataFrame(
        [("a", 1, base64.b64encode(b"{\\rtf NMUH note}").decode(), 1, "x"), ("b", 1, "*", 2, "x")],
        "id string, blob_sequence_num int, binarydoc string, ordinal long, dept string")
    assembled = Flow([AssembleDocuments()], cut=cut).run(parts)
    texts = assembled.good.select(F.col("id").alias("_id"), F.col("binarydoc").cast("string").alias("body"), "dept")
    flow = Flow([SchemaMap(mapping={"text": "body"}), TextScrub(), NlpRequests()])
    result = flow.run(texts)
    assert [(r["id"], r["text"], r["footer"]["dept"]) for r in rows(result.good)] == [("a", "{\\rtf  note}", "x")]
    assert [(r["step"], r["error"]) for r in rows(assembled.failures)] == [("AssembleDocuments", "invalid base64 in a part")]


def make_client():
    return lambda batch: batch.assign(size=batch["text"].str.len())[["size"]]


def test_annotate_documents(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "de")], "docid int, text string")
    ledger = spark.createDataFrame([("1",)], "document_id string")
    good, failed = split_failed(annotate_documents(docs, ledger, make_client, "size long"))
    assert [(r["id"], r["size"]) for r in rows(good)] == [("2", 2)] and rows(failed) == []


def test_cohort_artefacts(spark, tmp_path):
    patients = spark.createDataFrame(PATIENTS, PATIENT_SCHEMA)
    found = mentions(spark, [mention(10, "a", "2020-01-01T00:00:00"), mention(12, "a", None), mention(13, "b", "2020-01-01T00:00:01"), mention(10, "a", None, Subject=0)])
    write_cohort(build_cohort(patients, found, F.expr(AS_OF)), str(tmp_path))
    assert lines(tmp_path / "ptt2sex.json") == [{"p1": "Female", "p2": "Unknown", "p3": "Male"}]
    assert lines(tmp_path / "ptt2dob.json") == [{"p1": 19500201000000, "p2": 0, "p3": 19000101000000}]
    assert lines(tmp_path / "doc2ptt.json") == [{"10": "p1", "12": "p2", "13": "p3"}]
    assert sorted(lines(tmp_path / "cui2ptt_pos.jsonl"), key=str) == [{"a": {"p1": 1, "p2": 1}}, {"b": {"p3": 1}}]
    assert sorted(lines(tmp_path / "cui2ptt_tsp.jsonl"), key=str) == [{"a": {"p1": 1577836800}}, {"b": {"p3": 1577836801}}]
    assert len(rows(spark.read.json(str(tmp_path / "failures")))) == 1


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "id long, v long"

    def drain():
        rows_in = stream_documents(spark, str(source), schema, max_files=1)
        run_stream(rows_in, lambda b: (b.filter("v < 50"), b.filter("v >= 50")), f"{out}/good", f"{out}/failed", f"{out}/state").awaitTermination()

    spark.range(100).selectExpr("id", "id AS v").repartition(3).write.parquet(str(source))
    drain()
    spark.range(100, 120).selectExpr("id", "id - 100 AS v").write.mode("append").parquet(str(source))
    drain()
    assert sorted(r["id"] for r in rows(read_batches(spark, f"{out}/good"))) == [*range(50), *range(100, 120)]
    assert len(rows(read_batches(spark, f"{out}/failed"))) == 50
    assert len(list((out / "good").iterdir())) >= 4


def test_stream_works_out_a_batch_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    spark.range(50).write.parquet(str(tmp_path / "in"))
    rows_in = stream_documents(spark, str(tmp_path / "in"), "id long").mapInPandas(count, "id long")
    out = tmp_path / "out"
    run_stream(rows_in, lambda b: (b.filter("id < 20"), b.filter("id >= 20")), f"{out}/good", f"{out}/failed", f"{out}/state").awaitTermination()
    assert len(rows(read_batches(spark, f"{out}/good"))) == 20 and len(rows(read_batches(spark, f"{out}/failed"))) == 30
    assert seen.value == 50


def test_streams_read_a_table_in_several_files(spark, tmp_path):
    from workload.streams import stream_assembled, stream_flow

    one, many = tmp_path / "one", tmp_path / "many"
    docs = spark.range(1, 41).selectExpr("id AS doc_id", "repeat(concat('text ', id, ' '), id) AS text", "'en' AS lang")
    docs.repartition(3).write.parquet(f"{many}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/made")
    one.mkdir()
    next((tmp_path / "made").glob("part-*")).rename(one / "documents.parquet")
    for query in (stream_flow, stream_assembled):
        got = [sorted(map(str, query(spark, str(sf)).collect())) for sf in (one, many)]
        assert got[0] == got[1] and got[0]


def test_split_files_are_read_once(spark, tmp_path):
    from workload.files import split_files

    spark.range(200).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    back = split_files(spark, str(tmp_path))
    assert back._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted(map(tuple, back.collect())) == [(i, "F", True) for i in range(200)]


class _Calls:
    """State of one key, in memory; counts what is asked of it."""

    def __init__(self):
        self.held, self.n = {}, 0

    def _asked(self, value=None):
        self.n += 1
        return value

    def exists(self):
        return self._asked(bool(self.held))

    def get(self):
        return self._asked(self.held.get(None))

    def update(self, value):
        self.held[None] = self._asked(value)

    def getValue(self, key):  # noqa: N802
        return self._asked(self.held.get(key))

    def containsKey(self, key):  # noqa: N802
        return self._asked(key in self.held)

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = self._asked(value)

    def iterator(self):
        return iter(self._asked(list(self.held.items())))

    def clear(self):
        self._asked(self.held.clear())


def test_assembly_asks_its_state_for_blocks_of_parts():
    def run(*batches):
        state = {n: _Calls() for n in ("parts", "known", "done")}
        part = assembly._Assembler("fail", False, None, None)
        part.parts, part.known, part.done = state["parts"], state["known"], state["done"]
        names = ("id", "seq", "ordinal", "bin", "total")
        found = []
        for batch in batches:
            made = [{"id": "a", "seq": s, "ordinal": None, "bin": base64.b64encode(t.encode()).decode(), "total": n} for s, t, n in batch]
            found += list(part.handleInputRows(("a",), iter([{k: m[k] for k in names} for m in made]), None))
        return [(bytes(r["payload"] or b"").decode(), r["error"]) for r in found], sum(s.n for s in state.values())

    many = [(i, chr(97 + i % 26), 100) for i in range(1, 101)]
    text = "".join(t for _, t, _ in many)
    assert run(many) == ([(text, None)], 3)
    found, asked = run(many[::2], many[1::2])
    assert found == [(text, None)] and asked < 25
    # The last batch has parts of one block only; the others are read from state.
    assert run(many[:70], many[70:])[0] == [(text, None)]
    assert run(many[:70], [(3, "other", 100)])[0] == [("", "duplicate sequence number")]
    assert run(many[:70], many[:5], many[64:])[0] == [(text, None)]


class _Entries(_Calls):
    """A map state of a bucket."""

    def removeKey(self, key):  # noqa: N802
        self.held.pop(key, None)
        self.n += 1


def _arriving(rng, places):
    """Batches of parts of six documents: some come twice, some with other bytes, some without a number."""
    parts = []
    for d in "abcdef":
        total = rng.randrange(1, places)
        for i in range(total):
            seq = None if d == "e" or (d == "f" and rng.random() < 0.1) else i + 1
            text = base64.b64encode(f"{d}{i}".encode()).decode()
            copies = [(d, seq, i * 7, text, total)] * rng.choice([1, 1, 1, 2])
            if rng.random() < 0.02:
                copies.append((d, seq, i * 7 + 1, rng.choice(["b3RoZXI=", None, "*"]), total))
            parts += copies
    rng.shuffle(parts)
    cuts = sorted(rng.randrange(len(parts)) for _ in range(3))
    return [parts[low:high] for low, high in zip([0, *cuts], [*cuts, len(parts)])]


@pytest.mark.parametrize("many", [1, 16])
@pytest.mark.parametrize("dup", ["fail", "keep_first"])
def test_a_bucket_of_documents_gives_what_each_alone_gives(dup, many, monkeypatch):
    monkeypatch.setattr(assembly, "MANY", many)
    rng = random.Random(17)
    for _ in range(60):
        bucket = assembly._Buckets(dup, True, None, None)
        bucket.documents, bucket.parts = _Entries(), _Entries()
        alone, found = {}, ([], [])
        for batch in _arriving(rng, rng.choice([3, 20, 120])):
            frame = pd.DataFrame(
                [(d, s or 0, s is not None, o, True, text, n, True) for d, s, o, text, n in batch],
                columns=["id", "seq", "has_seq", "ordinal", "has_ordinal", "bin", "total", "has_total"])
            for out in bucket.handleInputRows((0,), iter([frame[:9], frame[9:]]), None):
                found[0].extend(tuple(None if pd.isna(v) else v for v in r) for r in out.itertuples(index=False))
            for d in dict.fromkeys(p[0] for p in batch):
                if d not in alone:
                    alone[d] = assembly._Assembler(dup, True, None, None)
                    alone[d].parts, alone[d].known, alone[d].done = _Calls(), _Calls(), _Calls()
                rows_in = [dict(zip(("seq", "ordinal", "bin", "total"), p[1:])) for p in batch if p[0] == d]
                found[1].extend(tuple(r) for r in alone[d].handleInputRows((d,), iter(rows_in), None))
        assert found[0] == found[1] and found[0]
        # What is closed leaves its mark only.
        assert {k[0] for k in bucket.parts.held} <= {k[0] for k, v in bucket.documents.held.items() if v[0]}


def test_a_bucket_takes_a_call_for_a_document_and_batch():
    bucket = assembly._Buckets("fail", False, None, None)
    bucket.documents, bucket.parts = _Entries(), _Entries()
    got = []
    for i in range(4):
        frame = pd.DataFrame({"id": [f"d{k}" for k in range(300)], "seq": i, "bin": "eA==", "total": 4, "ordinal": 0}).assign(has_seq=True, has_total=True, has_ordinal=False)
        got += [r for out in bucket.handleInputRows((0,), iter([frame]), None) for r in out["payload"]]
    assert got == [b"xxxx"] * 300 and bucket.documents.n == 4 * (1 + 300) and bucket.parts.n == 0


def test_texts_are_cut_up_once_for_all_lots(spark, tmp_path):
    from workload import streams

    spark.range(1, 31).selectExpr("id AS doc_id", "repeat(concat('text ', id, ' '), id * 9) AS text", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    dealt = streams._arrivals(spark, str(tmp_path))
    lots = [dealt.filter(F.col("lot") == n).drop("lot") for n in range(3)]
    assert all("InMemoryTableScan" in lot._jdf.queryExecution().executedPlan().toString() and lot.count() for lot in lots)
    dealt.unpersist()
    assert streams.stream_batches(spark, str(tmp_path)).count() and spark.sparkContext._jsc.getPersistentRDDs().size() == held


def make_counting_client():
    return lambda batch: batch.assign(size=batch["id"] * 2)[["size"]]


def test_stream_of_service_calls(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    rows_in = stream_documents(spark, str(tmp_path / "in"), "id long")
    run_tagged(rows_in, lambda b: enrich(b, make_counting_client, ["id"], "size long"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    good, failed = split_failed(read_batches(spark, str(tmp_path / "out")), drop=["size"])
    assert {r["id"]: r["size"] for r in rows(good)} == {i: 2 * i for i in range(20)} and rows(failed) == []


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


PARTS = "id string, seq long, bin string, total long"


def part_file(spark, source, parts):
    spark.createDataFrame([(d, s, base64.b64encode(b.encode()).decode(), n) for d, s, b, n in parts], PARTS).coalesce(1).write.mode("append").parquet(str(source))


def test_stream_assembly_over_several_batches(spark, tmp_path, rocksdb):
    source, out = tmp_path / "in", tmp_path / "out"

    def drain():
        parts = stream_documents(spark, str(source), PARTS, max_files=1)
        whole = stream_assemble_blobs(parts, "id", "seq", "bin", "total")
        run_stream(whole, lambda b: (b.filter("error IS NULL"), b.filter("error IS NOT NULL")), f"{out}/good", f"{out}/failed", f"{out}/state").awaitTermination()

    part_file(spark, source, [("a", 2, "lo", 2), ("b", 1, "x", 1), ("c", 1, "1", 3), ("g", 1, "x", 2), (None, 1, "q", 1), ("", 1, "q", 1)])
    drain()
    part_file(spark, source, [("a", 1, "hel", 2), ("a", 2, "lo", 2), ("c", 1, "other", 3), ("g", 3, "x", 2), ("b", 2, "late", 1)])
    drain()
    good = {r["id"]: bytes(r["payload"]) for r in rows(read_batches(spark, f"{out}/good"))}
    assert good == {"a": b"hello", "b": b"x"}
    assert {r["id"]: r["error"] for r in rows(read_batches(spark, f"{out}/failed"))} == {
        None: "missing document id", "": "missing document id",
        "b": "part arrived after the document was closed", "c": "duplicate sequence number", "g": "sequence gap"}
    # The batch operator gives the same for what is whole.
    batch = spark.createDataFrame([("a", 2, "lo", 1), ("a", 1, "hel", 2)], "id string, blob_sequence_num long, t string, ordinal long")
    whole, _ = assemble_blobs(batch.withColumn("binarydoc", base64_text(F.encode("t", "UTF-8"))).drop("t"))
    assert bytes(whole.first().binarydoc) == good["a"]


def test_stream_assembly_time_limit(spark, tmp_path, rocksdb):
    source, out = tmp_path / "in", tmp_path / "out"
    part_file(spark, source, [("a", 1, "x", 2)])
    whole = stream_assemble_blobs(stream_documents(spark, str(source), PARTS), "id", "seq", "bin", "total", timeout_ms=1000)
    seen = []
    query = (
        whole.writeStream.foreachBatch(lambda b, i: seen.extend(rows(b))).option("checkpointLocation", str(out)).trigger(processingTime="1 second").start()
    )
    try:
        until = time.time() + 60
        while not seen and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r["id"], r["error"]) for r in seen] == [("a", "parts missing at the time limit")]


ORDERED = "id string, seq long, bin string, total long, ordinal long"


def ordered_file(spark, source, parts):
    made = [(d, s, None if b is None else base64.b64encode(b.encode()).decode(), n, o) for d, s, b, n, o in parts]
    spark.createDataFrame(made, ORDERED).coalesce(1).write.mode("append").parquet(str(source))


@pytest.mark.parametrize("dup", ["fail", "keep_first", "keep_last"])
def test_stream_assembly_orders_and_copies(spark, tmp_path, rocksdb, dup):
    source, out = tmp_path / "in", tmp_path / "out"

    def drain():
        parts = stream_documents(spark, str(source), ORDERED, max_files=1)
        whole = stream_assemble_blobs(parts, "id", "seq", "bin", "total", ordinal_col="ordinal", dup=dup)
        run_stream(whole, lambda b: (b.filter("error IS NULL"), b.filter("error IS NOT NULL")), f"{out}/good", f"{out}/failed", f"{out}/state").awaitTermination()

    # c: copies of part 1 in two batches; n: no numbers; m: a number on one part only; e: nothing in a part.
    ordered_file(spark, source, [("c", 1, "second", 2, 5), ("n", None, "b", 2, 20), ("m", 1, "x", 2, 1), ("e", 1, None, 1, 1), ("t", None, "x", 3, 7)])
    drain()
    ordered_file(spark, source, [("c", 1, "first", 2, 3), ("c", 1, "first", 2, 3), ("n", None, "a", 2, 10), ("m", None, "y", 2, 2), ("t", None, "y", 3, 7)])
    drain()
    ordered_file(spark, source, [("c", 2, "!", 2, 9), ("n", None, "a", 2, 10)])
    drain()
    good = {r["id"]: bytes(r["payload"]).decode() for r in rows(read_batches(spark, f"{out}/good"))}
    late = "part arrived after the document was closed"
    failed = sorted((r["id"], r["error"]) for r in rows(read_batches(spark, f"{out}/failed")))
    want = [("e", "missing payload in a part"), ("m", "sequence number on some parts only"), ("n", late), ("t", "ordinal of a part without sequence number comes twice")]
    if dup == "fail":
        assert good == {"n": "ab"} and failed == sorted([*want, ("c", "duplicate sequence number"), ("c", late)])
    else:
        assert good == {"n": "ab", "c": "first!" if dup == "keep_first" else "second!"} and failed == want


def test_stream_assembly_needs_an_order_for_copies(spark):
    df = spark.createDataFrame([], ORDERED)
    with pytest.raises(ValueError, match="ordinal_col"):
        stream_assemble_blobs(df, "id", "seq", "bin", "total", dup="keep_last")
    with pytest.raises(ValueError, match="dup"):
        stream_assemble_blobs(df, "id", "seq", "bin", "total", ordinal_col="ordinal", dup="none")


def test_closed_documents_are_forgotten_in_time(spark, tmp_path, rocksdb):
    source, out = tmp_path / "in", tmp_path / "out"
    part_file(spark, source, [("a", 1, "x", 1)])
    parts = stream_documents(spark, str(source), PARTS)
    whole = stream_assemble_blobs(parts, "id", "seq", "bin", "total", keep_closed_ms=2000)
    seen = []
    query = (
        whole.writeStream.foreachBatch(lambda b, i: seen.extend(rows(b))).option("checkpointLocation", str(out)).trigger(processingTime="1 second").start()
    )
    try:
        for n in (1, 2):
            until = time.time() + 60
            while len(seen) < n and time.time() < until:
                time.sleep(0.5)
            time.sleep(3)
            if n == 1:
                part_file(spark, source, [("a", 1, "x", 1)])
    finally:
        query.stop()
    assert [(r["id"], r["error"]) for r in seen] == [("a", None), ("a", None)]
