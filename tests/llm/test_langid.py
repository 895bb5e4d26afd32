from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np

from chartloom.llm import langid
from chartloom.llm.queries import QUERIES


def trigrams(text):
    text = (text or "").lower()
    clean = "".join(c if c.isalpha() else " " for c in text)
    found = Counter()
    for word in clean.split():
        padded = f" {word} "
        found.update(padded[i : i + 3] for i in range(len(word)))
    return found


def vector(counts):
    letters = sorted({0 if c == " " else ord(c) for g in counts for c in g})
    base = dict(zip(letters, langid.letter_vectors(np.array(letters)), strict=True)) if letters else {}
    total = np.zeros(langid.DIMS)
    for gram, n in counts.items():
        a, b, c = (base[0 if x == " " else ord(x)].astype(float) for x in gram)
        total += n * a * np.roll(b, 1) * np.roll(c, 2)
    return total


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    grams = defaultdict(Counter)
    out = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2
    for d in docs:
        if not out(d) and d["lang"] is not None:
            grams[d["lang"]].update(trigrams(d["text"]))
    known = {lang: vector(g) for lang, g in sorted(grams.items())}
    right = tested = 0
    got = {r["doc_id"]: r for r in QUERIES["op7_language_id"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        row, v = got[d["doc_id"]], vector(trigrams(d["text"]))
        assert row["held_out"] == out(d)
        if not v.any():
            assert row["lang_pred"] == "und"
            continue
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in known.items()}
        best = max(cosines, key=cosines.get)
        assert row["lang_pred"] == best and abs(row["score"] - max(0, cosines[best])) < 1e-6
        if out(d):
            tested += 1
            right += row["lang_pred"] == d["lang"]
    assert right >= 0.95 * tested


def test_edge_rows(spark):
    train = spark.createDataFrame([("a", "aaa aba"), ("b", "zzz zyz"), (None, "qqq"), ("c", None), ("d", "12 !")], "lang string, text string")
    profiles = langid.learn(train)
    assert profiles.languages == ["a", "b"]
    rows = [(1, None, 0.0), (2, "", 0.0), (3, "12 .", 0.0), (4, "ABA", 0.0), (4, "ABA", 0.0), (5, "zyz " * 300_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted((r["doc_id"], r["lang_pred"], r["score"] > 0) for r in langid.identify(df, profiles).collect())
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "a", True), (4, "a", True), (5, "b", True)]
    assert langid.identify(df.limit(0), profiles).count() == 0
    nothing = langid.learn(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}


def test_long_texts_are_summed_up_whole():
    text = "abc déf " * 20_000
    whole, cut = langid.Bundler(), langid.Bundler()
    old, langid.CHARS = langid.CHARS, 1000
    try:
        parts = cut.bundles([text, "x"])
    finally:
        langid.CHARS = old
    assert np.allclose(whole.bundles([text, "x"]), parts)
