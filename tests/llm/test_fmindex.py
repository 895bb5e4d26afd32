from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import fmindex


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if names := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def ours(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, leak string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = fmindex.find_leaks(d, b, **options).collect()
    return sorted(((r["doc_id"], r["leak"]["n_words"], r["leak"]["n_hit"], r["leak"]["items"]) for r in found), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 6), min_size=3, max_size=3), min_size=1, max_size=8))
def test_index(text, phrases):
    symbols = np.array([*text, 0])
    assert fmindex.suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
    index = fmindex.FMIndex(symbols)
    found, low, high = index.search(np.array(phrases))
    got = {int(f): sorted(index.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, low, high, strict=True)}
    want = {k: [i for i in range(len(text) - 2) if text[i : i + 3] == p] for k, p in enumerate(phrases)}
    assert got == {k: v for k, v in want.items() if v}


ITEM = "One two three four, five six seven eight nine ten eleven twelve."
DOCS = [
    (1, "intro " + ITEM + " outro"), (2, ITEM.upper() + " x " + ITEM), (3, "one two three four five six seven eight nine"), (4, None), (5, ""),
    (5, ""), (None, "say short item now"), (6, "short item short item"), (7, "tre é über ñ " * 3), (8, "one two three four five six seven eight nine ten\n" * 3),
    (9, "filler " * 50_000 + ITEM), (10, "two three four five six seven eight nine ten eleven twelve one two"),
]
ITEMS = [(1, ITEM), (1, "short item"), (2, "Short ITEM!"), (3, None), (4, " .,"), (None, "é über ñ tre é über ñ tre é über"), (11, ITEM)]


def test_against_brute_force(spark):
    assert ours(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_many_blocks_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", 5)
    assert ours(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_no_items_and_no_rows(spark):
    assert ours(spark, DOCS, ITEMS[3:5]) == brute(DOCS, [])
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert fmindex.find_leaks(empty, items).count() == 0


def test_passages_are_cut_out(spark):
    d = spark.createDataFrame([(1, "Before it. " + ITEM + " After it."), (2, "clean text, as it is"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: r["clean"] for r in fmindex.find_leaks(d, b, clean_col="clean").collect()}
    assert got == {1: "Before it. \n. After it.", 2: "clean text, as it is", 3: None}
