"""What is kept between runs: keyed tables, partial results, marks, a text index."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chartloom.operators import match_indexed, match_text, search_index, write_text_index
from chartloom.operators.textindex import postings
from chartloom.sources import (
    MarkLog,
    create_keyed,
    file_marks,
    latest_version,
    merge_files,
    merged_partials,
    read_keyed,
    replace_keyed,
    run_batches,
    upsert_keyed,
    versioned_parquet,
)


def ids(df, col="id"):
    return sorted((r[col] for r in df.select(col).collect()), key=str)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "/data/" in str(p)}


def test_an_update_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(1000).select("id", F.lit("old").alias("v"), F.lit(0).alias("at"))
    assert latest_version(spark, path) == -1
    assert create_keyed(base, path, "id", buckets=50) == 0
    with pytest.raises(ValueError, match="already"):
        create_keyed(base, path, "id")
    before = files(path)
    updates = spark.createDataFrame([(7, "new", 2), (7, "late", 3), (7, "lost", 1), (5000, "added", 1)], "id long, v string, at int")
    assert upsert_keyed(updates, path, "at") == 1
    after = files(path)
    assert {f: after[f] for f in before} == before
    assert len({f.split("_bucket=")[1].split("/")[0] for f in after if f not in before}) <= 2
    now = {r["id"]: r["v"] for r in read_keyed(spark, path).collect()}
    assert len(now) == 1001 and now[7] == "late" and now[5000] == "added" and now[8] == "old"
    assert {r["v"] for r in read_keyed(spark, path, 0).collect()} == {"old"}
    plan = read_keyed(spark, path).inputFiles()
    assert not any("version=1" not in f and f.split("_bucket=")[1].split("/")[0] in {g.split("_bucket=")[1].split("/")[0] for g in after if g not in before} for f in plan)


def test_a_failed_update_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    create_keyed(spark.range(10).withColumn("v", F.lit(0)), path, "id", buckets=4)
    bad = spark.range(3).select("id", F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.lit(1)).cast("int").alias("v"))
    with pytest.raises(Exception, match="no"):
        upsert_keyed(bad, path, "v")
    assert latest_version(spark, path) == 0
    # Data without a manifest, as a run leaves them that dies in between, are nobody's.
    spark.range(99).write.parquet(f"{path}/data/version=1/_bucket=0")
    assert read_keyed(spark, path).count() == 10
    upsert_keyed(spark.range(3).withColumn("v", F.lit(5)), path, "v")
    assert sorted(r["v"] for r in read_keyed(spark, path).collect()) == [0] * 7 + [5] * 3
    with pytest.raises(ValueError, match="no version"):
        read_keyed(spark, path, 9)


def test_keyed_edge_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    create_keyed(spark.createDataFrame([], "k string, v int"), path, "k", buckets=3)
    assert read_keyed(spark, path).count() == 0
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("", 4)], "k string, v int")
    replace_keyed(rows, path)
    replace_keyed(rows.filter("k = 'a' AND v = 2").withColumn("more", F.lit("x")), path)
    got = sorted((str(r["k"]), r["v"], r["more"]) for r in read_keyed(spark, path).collect())
    assert got == [("", 4, None), ("None", 3, None), ("a", 2, "x")]
    replace_keyed(rows.limit(0), path)
    assert latest_version(spark, path) == 3 and read_keyed(spark, path).count() == 3


def test_files_merged_again(spark, tmp_path):
    path = str(tmp_path / "p")

    def merge(rows):
        df = spark.createDataFrame(rows, "file string, cui string, patient string, at long")
        facts = df.filter("cui IS NOT NULL").groupBy("file", "cui", "patient").agg(F.count("*").alias("n"), F.min("at").alias("first_seen"))
        return merge_files(facts, file_marks(df, "file"), path, buckets=3)

    def now():
        return sorted(tuple(r) for r in merged_partials(spark, path).collect())

    one, two = [("f1", "C", "p", 5), ("f1", "C", "p", 3), ("f1", "D", "p", 0)], [("f2", "C", "p", 1), ("f2", "C", "q", 9)]
    merge(one + two)
    assert now() == [("C", "p", 3, 1), ("C", "q", 1, 9), ("D", "p", 1, None)]
    merge(list(reversed(one)))
    assert now() == [("C", "p", 3, 1), ("C", "q", 1, 9), ("D", "p", 1, None)]
    merge([("f2", "C", "q", 9)])
    assert now() == [("C", "p", 2, 3), ("C", "q", 1, 9), ("D", "p", 1, None)]
    merge([("f1", None, None, None)])
    assert now() == [("C", "q", 1, 9)]
    merge(one)
    assert now() == [("C", "p", 2, 3), ("C", "q", 1, 9), ("D", "p", 1, None)]


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "timestamp", "timestamp_ntz", "decimal(20,3)"])
def test_batches_go_on_after_a_crash(spark, tmp_path, kind):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    value = {"bigint": F.col("id"), "string": F.lpad(F.col("id").cast("string"), 4, "0"), "decimal(20,3)": F.col("id").cast(kind) / 8}.get(kind, day)
    whole = spark.range(40).select("id", value.cast(kind).alias("k")).union(spark.range(100, 102).select("id", F.lit(None).cast(kind).alias("k")))
    log, out = MarkLog(spark, str(tmp_path / "log")), str(tmp_path / "out")

    def upto(n):
        return whole.filter(F.col("id").between(0, n) | F.col("k").isNull())

    assert log.next_batch(whole.filter("id < 0"), "k") is None and log.high_water() is None
    assert run_batches(log, lambda: upto(9), "k", versioned_parquet(out)) == 1
    assert run_batches(log, lambda: upto(9), "k", versioned_parquet(out)) == 0
    # Read and not written: the next run reads the same rows, not the later ones.
    lost = log.next_batch(upto(19), "k")
    assert (lost.version, lost.again) == (1, False)
    again = MarkLog(spark, log.path).next_batch(upto(29), "k")
    assert (again.version, again.again, again.low, again.high) == (1, True, lost.low, lost.high)
    assert ids(again.rows) == list(range(10, 20))
    # Written and not said so: written again in its own place.
    versioned_parquet(out)(again.rows, again.version)
    assert run_batches(log, lambda: upto(39), "k", versioned_parquet(out)) == 2
    got = spark.read.parquet(out)
    assert ids(got) == sorted([*range(40), 100, 101], key=str)
    assert sorted({(r["version"], r["id"]) for r in got.filter("id IN (0, 100, 10, 20)").collect()}) == [(0, 0), (0, 100), (1, 10), (2, 20)]


def test_one_writer_of_a_version(spark, tmp_path):
    log = MarkLog(spark, str(tmp_path))
    batch = log.next_batch(spark.range(5), "id")
    log.done(batch)
    with pytest.raises(Exception, match="(?i)exist"):
        log.done(batch)
    assert log.high_water() == "4"
    pushed = log.next_batch(spark.read.schema("id long").parquet(_stored(spark, tmp_path)), "id")
    assert "GreaterThan(id,4)" in pushed.rows._jdf.queryExecution().executedPlan().toString()


def _stored(spark, tmp_path):
    spark.range(9).write.parquet(str(tmp_path / "src"))
    return str(tmp_path / "src")


TEXTS = [
    (1, "Chest pain, and X-ray of the chest"), (2, "pain in the chest; chest-pain"), (3, None), (4, ""), (5, "ÉCOLE école 北京 and"),
    (6, "the x ray the ray x"), (None, "chest pain"), (7, "pain chest"), (7, "x-ray x-ray"), (7, "x-ray x-ray"), (8, "one two one two three " * 300),
]


def test_index_finds_what_the_texts_have(spark, tmp_path):
    df = spark.createDataFrame([(i, t, 0) for i, t in TEXTS], "id int, text string, places int")
    path = str(tmp_path / "index")
    write_text_index(df.filter("id IS NULL OR id < 6"), "id", "text", path, "a")
    write_text_index(df.filter("id >= 6"), "id", "text", path, "b")
    write_text_index(df.filter("id >= 6"), "id", "text", path, "b")
    for terms in (["chest"], ["chest pain"], ["x-ray", "école"], ["two one two three"], ["ray x"], ["and", "the"], ["--"], ["absent"], [], ["one two", "--"], ["北京 AND"]):
        for every in (False, True):
            want = sorted(map(str, match_text(df, "text", terms, every).collect()))
            got = sorted(map(str, match_indexed(df, path, "id", "text", terms, every).collect()))
            assert got == want, (terms, every)
    changed = df.withColumn("text", F.when(F.col("id") == 1, "nothing").otherwise(F.col("text")))
    assert 1 not in ids(match_indexed(changed, path, "id", "text", ["chest"]))


def test_postings_are_made_where_texts_are_read(spark):
    df = spark.createDataFrame([(1, "b a, b", 0), (2, None, 0), (3, "--", 0), (None, "a", 0)], "id int, text string, n int")
    held = postings(df, "id", "text")
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r["id"], r["term"], r["places"]) for r in held.collect()), key=str) == [(1, "a", [1]), (1, "b", [0, 2]), (None, "a", [0])]


def test_search_reads_its_buckets_only(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    path = str(tmp_path / "index")
    write_text_index(df, "id", "text", path, "a")
    plan = search_index(spark, path, ["chest pain"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_moments_in_any_zone(spark, tmp_path):
    log = MarkLog(spark, str(tmp_path))
    moments = [datetime.datetime(2024, 3, 31, 0, 59, 59, 999999), datetime.datetime(2024, 10, 27, 1, 30)]
    df = spark.createDataFrame([(m,) for m in moments], "at timestamp")
    log.done(log.next_batch(df.limit(1), "at"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/London")
        assert log.next_batch(df, "at").rows.count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
