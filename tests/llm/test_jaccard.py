from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from chartloom.llm import groups, jaccard
from chartloom.llm.queries import QUERIES


def grams(text, size=5):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(size, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows):
    """class_id, n_links and n_copies by all pairs of different sets."""
    sets = [grams(t) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    at = {s: i for i, s in enumerate(kinds)}
    parent, links = list(range(len(kinds))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(kinds):
        for g in s:
            holders.setdefault(g, []).append(i)
    seen = {(i, j) for held in holders.values() for i in held for j in held if i < j}
    for i, j in seen:
        both = len(kinds[i] & kinds[j])
        if both * 5 >= 4 * (len(kinds[i]) + len(kinds[j]) - both):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = {}
    for (doc, _), s in zip(rows, sets, strict=True):
        if s and doc is not None:
            k = root(at[s])
            least[k] = min(least.get(k, doc), doc)
    copies = Counter(sets)
    out = []
    for (doc, _), s in zip(rows, sets, strict=True):
        out.append((doc, least.get(root(at[s])), links[at[s]], copies[s]) if s else (doc, doc, 0, 1))
    return sorted(out, key=str)


def ours(df):
    found = jaccard.near_duplicates(df).select("doc_id", "class_id", "n_links", "n_copies").collect()
    return sorted((tuple(r) for r in found), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op2_ngram_jaccard"](spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_groups_of_near_copies(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for g in range(3):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for k in range(90 if g == 0 else 12):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((1000 * g + k, " ".join(words)))
    rows += [(9000 + i, " ".join(rng.choice(vocabulary) for _ in range(50))) for i in range(30)]
    monkeypatch.setattr(groups.in_blocks, "__defaults__", (16,))
    got = ours(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [r[1] for r in got] == [r[1] for r in want]
    # A pair just at the threshold may be missed with a probability of 1 in 1000.
    missed = sum(w[2] - g[2] for w, g in zip(want, got, strict=True))
    assert 0 <= missed <= 0.001 * sum(w[2] for w in want)


def test_edge_rows(spark):
    long = "alpha beta gamma delta " * 30_000
    rows = [(1, None), (2, ""), (3, " .,- "), (4, "a b"), (5, "A, b!"), (None, "a b"), (6, long), (6, long), (7, long + "x"), (8, "a b c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    assert ours(df) == brute(rows)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(df).collect())
    assert kept == [1, 2, 3, 4, 6, 8]
    assert jaccard.keep_one(df).columns == df.columns


def test_classes_apart_whatever_their_ids(spark):
    rows = [(None, "red green blue cyan pink"), (None, "one two three four five"), (None, "one two, three FOUR five"), (None, "a b c"), (None, " - "), (None, None)]
    rows += [(1, "north south east west up"), (1, "spring summer autumn winter rain"), (1, "..."), (1, "north south east west up")]
    rows += [(i, text) for i in range(2, 12) for text in (f"text number {chr(95 + i)} of some", "." * i)]
    rows += [(0, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df) == brute(rows)
    best = {}
    for doc, text in rows:
        best.setdefault(grams(text), []).append(doc)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()]
    assert sorted((grams(t) for _, t in kept if grams(t)), key=str) == sorted((g for g in best if g), key=str)
    assert sorted(str(r) for r in kept if not grams(r[1])) == sorted(str(r) for r in rows if not grams(r[1]))
    assert (0, "a b c") in kept and (None, "a b c") not in kept


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "src long, dst long")
    got = [tuple(r) for r in groups.components(df).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert groups.components(df.limit(0)).count() == 0


def test_shared_key_edges(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (3, 7), (3, 8), (3, 9), (3, 9), (4, 1)], "key long, id long")
    assert sorted(tuple(r) for r in groups.shared_key_edges(df).collect()) == [(6, 5), (8, 7), (9, 7)]


def test_overlaps():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 60))).astype(np.uint64) for _ in range(20)]

    def held(part):
        return np.concatenate(part), np.repeat(np.arange(len(part)), [len(s) for s in part])

    got = jaccard.overlaps(held(sets[:8]), 8, held(sets[8:]), 12)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]


def test_bands():
    assert 1 - (1 - 0.8**5) ** jaccard.bands_for(0.8, 0.99) >= 0.99
