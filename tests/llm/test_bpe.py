from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chartloom.llm import bpe
from chartloom.llm.queries import QUERIES
from chartloom.llm.queries_text import vocabulary_path

PATH = vocabulary_path()
VOCABULARY = bpe.Vocabulary.load(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def ours(text):
    packed = bpe.Encoder(VOCABULARY).encode(text)
    return np.frombuffer(packed, "<u4").tolist(), bpe.decode(packed, VOCABULARY.tokens)


TEXTS = [
    "", " \n", "Hello, world's 123rd  test!!", "it'S we'LL <|endoftext|>x <|startoftext|><|endoftext|> <|EndOfText|>", "ΑΣ ΟΔΟΣ İI ǅ ß ﬁ",
    "é ́a a b a​b a\x1cb\x1fc a\x85b", "日本語 ไทย 👩‍👩‍👧 ½ ² Ⅷ ٣", "x" * 700, "ab" * 400 + "é" * 300, "a'b'c''s's", "\x00\x01 ﻿ x",
]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    assert ours(text) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    # Letters younger than the library's tables may be sorted otherwise.
    import unicodedata

    if all(unicodedata.category(c) != "Cn" for c in text):
        assert ours(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aehinrst", min_size=1, max_size=120))
def test_both_merges_agree(word):
    parts = [VOCABULARY.inner[b] for b in word.encode()]
    parts[-1] = VOCABULARY.final[ord(word[-1])]
    assert bpe.merge_short(list(parts), VOCABULARY.merges) == bpe.merge_long(list(parts), VOCABULARY.merges)


def test_edge_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, "a b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(bpe.encode_texts(df, PATH).select("doc_id", "n_tokens", "decoded").collect(), key=str)
    assert got == sorted([(1, 0, ""), (1, 0, ""), (None, 0, ""), (2, 2, "a</w> b</w>")], key=str)
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0


def test_query(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op8_bpe_codec"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids, text = library(doc["text"] or "")
        row = got[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
