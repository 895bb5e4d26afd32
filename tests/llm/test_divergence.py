from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from chartloom.llm import divergence


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, least=10, top=10):
    """The contract, every kept term of every group looked at."""
    docs, counts, lang_counts = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang or "", source or "") for lang, source, _ in rows})
    for lang, source, text in rows:
        found = Counter(terms(text))
        docs[lang or ""].update(found.keys())
        counts[lang or "", source or ""].update(found)
        lang_counts[lang or ""].update(found)
    gap = lambda p, q: (p - q) * (p - q) // (p + q)
    out = []
    for lang in sorted({g[0] for g in groups}):
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(lang_counts[lang])
        p = {g: shares(counts[g]) for g in groups if g[0] == lang}
        for g in p:
            pair = [(-sum(gap(p[g][t], p[o][t]) for t in kept), o[1].encode(), o[1]) for o in p if o != g]
            own = [(-gap(p[g][t], q[t]), t.encode(), t) for t in kept if counts[g][t] > 0 and p[g][t] > q[t]]
            out += [(*g, "pair", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(pair))]
            out += [(*g, "term", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(own)[:top])]
    return sorted(out)


def ours(df, **options):
    found = divergence.audit(df, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def test_random_documents(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 500)
    monkeypatch.setattr(divergence, "PIECE", 200)
    rng = random.Random(7)
    vocabulary = ["the", "The", "é", "ÉCOLE", "日本", "a-b", "x1y", "snake_case", "\x85", "\xa0z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "Z", "é", None])
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 5, 60]))
        rows.append((lang, source, rng.choice([" ", "\t", ", ", "\n"]).join(words)))
    rows += [("en", "s1", "the " * 2000), ("en", "silent", None), ("xx", "a", "rare words"), ("xx", "b", ""), ("one", "only", "x y z")] * 2
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit("x"))
    assert ours(df) == brute(rows)
    assert ours(df, least_docs=1, top=3) == brute(rows, 1, 3)
    assert divergence.audit(df.limit(0)).count() == 0


def test_language_without_kept_terms(spark):
    df = spark.createDataFrame([("a", "x", "rare"), ("a", "y", None), ("b", None, "t")], "lang string, source string, text string")
    assert ours(df) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]


def test_terms_of_a_long_text():
    text = ("Abc déf " * 300_000 + "tail").encode()
    assert divergence.term_counts(text) == {b"abc": 300_000, "déf".encode(): 300_000, b"tail": 1}
    assert divergence.term_counts(b"x" * 3_000_000) == {b"x" * 3_000_000: 1}
