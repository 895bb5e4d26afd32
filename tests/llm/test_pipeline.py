from __future__ import annotations

import __spark_entry__
import corpus_pipeline as pipeline
from chartloom import checkpoint_folder
from chartloom.llm import quality
from chartloom.llm.common import table
from test_fmindex import brute as leaks
from test_jaccard import brute as classes


def staged(spark, sf, tmp):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, sf)
        made.write.parquet(f"{tmp}/{name}")
        docs = spark.read.parquet(f"{tmp}/{name}")
        out.append(docs)
    return out


def test_stages(spark, sf, tmp_path):
    checkpoint_folder(spark)
    start = table(spark, sf, "documents")
    judged, lines, documents, clean, tokens = staged(spark, sf, tmp_path)
    for df in (judged, lines, documents, clean):
        assert df.columns == start.columns
        assert df.filter("n_chars <> char_length(text)").count() == 0
    kept = quality.judge(start).filter("quality.kept").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in judged.collect()) == sorted(r["doc_id"] for r in kept)
    # no line of five words or more is left twice
    again = lines.selectExpr("explode(split(text, '\n')) AS line").filter("size(split(line, ' ')) >= 5").groupBy("line").count()
    assert again.filter("count > 1").count() == 0
    # one document of each class is left, and no class is lost
    want = {c for _, c, _, _ in classes([(r["doc_id"], r["text"]) for r in lines.collect()])}
    assert sorted(r["doc_id"] for r in documents.collect()) == sorted(want)
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    before = {d: (n, hit) for d, n, hit, _ in leaks([(r["doc_id"], r["text"]) for r in documents.collect()], items)}
    after = {d: (n, hit) for d, n, hit, _ in leaks([(r["doc_id"], r["text"]) for r in clean.collect()], items)}
    assert set(before) - set(after) == {d for d, (n, hit) in before.items() if hit == n}
    assert all(after[d][0] == before[d][0] - before[d][1] for d in after)
    assert sum(hit for _, hit in after.values()) == 0
    assert tokens.filter("n_tokens <> length(ids) div 4 OR n_tokens = 0").count() == 0
    assert sorted(r["doc_id"] for r in tokens.select("doc_id").collect()) == sorted(after)
    ran = __spark_entry__.queries()["pipeline"](spark, sf).select("doc_id", "ids_sha256", "decoded_sha256").collect()
    assert sorted(ran) == sorted(tokens.select("doc_id", "ids_sha256", "decoded_sha256").collect())


def test_no_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_odd_documents(spark, sf):
    text = "This is a sentence that is long enough, with a mark in it, to be kept by all the rules of the first stage. "
    rows = [(None, text), (1, None), (2, ""), (3, text), (3, text), (4, text + "Changed."), (5, "word " * 100_000)]
    docs = spark.createDataFrame([(*r, None, None, None, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, quality int")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        stage(spark, docs, sf).count()
    assert {r["quality"] for r in pipeline.quality_rules(spark, docs, sf).collect()} == {1}
    assert sorted(r["doc_id"] for r in pipeline.document_dedup(spark, docs.filter("doc_id IN (3, 4)"), sf).collect()) == [3]
