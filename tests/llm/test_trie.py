from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chartloom.llm import trie
from chartloom.llm.queries import QUERIES


def code_of(text):
    """The contract, word by word and bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """doc_id, fingerprint and component by all pairs of different fingerprints."""
    codes = [code_of(t) for _, t in rows]
    kinds = sorted(set(codes))
    values = np.array(kinds, dtype=np.uint64)
    parent = list(range(len(kinds)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ value) <= 2) + i + 1:
            parent[root(int(j))] = root(i)
    of = {c: root(i) for i, c in enumerate(kinds)}
    least = {}
    for (doc, _), c in zip(rows, codes):
        if doc is not None:
            least[of[c]] = min(least.get(of[c], doc), doc)
    return sorted(((doc, f"{c:016x}", least.get(of[c])) for (doc, _), c in zip(rows, codes)), key=str)


def ours(df, **options):
    found = trie.near_duplicates(df, **options).withColumn("code", trie.as_hex(F.col("code")))
    return sorted((tuple(r) for r in found.select("doc_id", "code", "component_id").collect()), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_simhash_trie"](spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 1000)
    long = "Alpha beta\tgamma\x0bdelta \x85 \xa0é " * 3000
    rows = [(1, None), (2, ""), (3, " \t\r\n "), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (None, "lonely words here now")]
    rows += [(None, None), (7, long), (8, long), (9, long + "x"), (10, "x" * 5000), (11, "È é"), (12, "a b c d")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, code int, id string")
    assert ours(df) == brute(rows)
    assert trie.near_duplicates(df.limit(0)).count() == 0
    assert trie.near_duplicates(df.filter("doc_id IS NULL AND text IS NOT NULL")).collect()[0]["component_id"] is None


def linked_by_force(codes, budget):
    values = np.array(codes, dtype=np.uint64)
    return {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= budget}


def some_codes(seed, n):
    """Random fingerprints, chains of near ones, and a prefix that a third of all share."""
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(n)}
    for code in rng.sample(sorted(codes), n // 4):
        for _ in range(4):
            code ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            codes.add(code)
    base = rng.getrandbits(64)
    codes |= {base ^ rng.getrandbits(9) for _ in range(n)} | {0, (1 << 64) - 1, 1, 3, 7}
    return sorted(codes)


def test_walk_against_all_pairs(monkeypatch):
    monkeypatch.setattr(trie, "WALKED", 50)
    for seed in range(4):
        codes = some_codes(seed, 150)
        for budget in (0, 1, 2, 3):
            whole = np.array(codes, dtype=np.uint64)
            got = [p for i, j in trie.walk(whole, None, 0, 0, budget) for p in zip(i.tolist(), j.tolist())]
            assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == linked_by_force(codes, budget)
            half = len(codes) // 2
            got = [p for i, j in trie.walk(whole[:half], whole[half:], 0, 0, budget) for p in zip(i.tolist(), (j + half).tolist())]
            assert len(got) == len(set(got)) and set(got) == {p for p in linked_by_force(codes, budget) if p[0] < half <= p[1]}


def test_links_connect_what_all_pairs_connect(spark):
    from chartloom.llm.groups import components

    codes = some_codes(9, 300)
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked_by_force(codes, 2):
        parent[root(i)] = root(j)
    want = {}
    for i, c in enumerate(codes):
        want.setdefault(root(i), set()).add(c)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    for leaf in (16, 100_000):
        edges = trie.trie_links(df, leaf=leaf)
        got = {}
        for r in components(edges).collect():
            got.setdefault(r["component"], set()).add(r["id"] % (1 << 64))
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)
