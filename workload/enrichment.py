"""Service, text model and location queries, with local stand-ins for the model."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import apply_text_model, assign_location, enrich
from workload import query
from workload.inputs import table


def _word_counter():  # noqa: ANN202
    words = re.compile("[a-z]+")

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["doc_id"] % 97 == 0).any():
            raise RuntimeError("cannot read this one")
        return pd.DataFrame({"n_words": [len(words.findall(t)) for t in batch["text"]]})

    return call


@query("enriched_documents", """
SELECT doc_id, lang, CASE WHEN doc_id % 97 <> 0 THEN len(regexp_extract_all(text, '[a-z]+')) END AS n_words,
  CASE WHEN doc_id % 97 = 0 THEN 'RuntimeError: cannot read this one' END AS error FROM documents""")
def enriched(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return enrich(docs, _word_counter, ["doc_id", "text"], "n_words long", batch_size=20, retries=1).drop("text")


def _slow_counter():  # noqa: ANN202
    """Answers late, fails the first time it sees every fifth request, and never answers some."""
    import threading
    import time

    seen, lock, words = set(), threading.Lock(), re.compile("[a-z]+")

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        time.sleep(0.002 * (len(batch) % 3))
        with lock:
            new = [k for k in batch["sent"] if k not in seen]
            seen.update(new)
        if any(int(k[:8], 16) % 5 == 0 for k in new):
            raise ConnectionError("try again")
        if (batch["doc_id"] % 97 == 0).any():
            raise RuntimeError("cannot read this one")
        return pd.DataFrame({"n_words": [len(words.findall(t)) for t in batch["text"]], "key": batch["sent"]})

    return call


@query("enriched_in_flight", """
SELECT doc_id, CASE WHEN doc_id % 97 <> 0 THEN len(regexp_extract_all(text, '[a-z]+')) END AS n_words, doc_id % 97 <> 0 AS same_key,
  CASE WHEN doc_id % 97 = 0 THEN 'RuntimeError: cannot read this one' END AS error FROM documents""")
def in_flight(spark: SparkSession, sf: str) -> DataFrame:
    """Eight calls under way at a time; the answer says which request it is for."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    called = enrich(docs, _slow_counter, ["doc_id", "text"], "n_words long, key string", batch_size=7, retries=2, in_flight=8, request_key="sent")
    mine = F.sha2(F.to_json(F.struct(F.col("doc_id").alias("r0"), F.col("text").alias("r1"))), 256)
    return called.select("doc_id", "n_words", F.coalesce(F.col("key") == mine, F.lit(False)).alias("same_key"), "error")


def _masker():  # noqa: ANN202
    def model(texts: pd.Series) -> pd.Series:
        return texts.str.replace("[0-9]", "#", regex=True) + "|"

    return model


@query("text_model_slices", """
SELECT doc_id, array_to_string(list_transform(generate_series(0, greatest(CAST(ceil(length(text) / 512.0) AS BIGINT) - 1, 0)),
  lambda i: regexp_replace(substr(text, i * 512 + 1, 512), '[0-9]', '#', 'g') || '|'), '') AS text FROM documents""")
def masked(spark: SparkSession, sf: str) -> DataFrame:
    return apply_text_model(table(spark, sf, "documents").select("doc_id", "text"), "text", _masker).drop("error")


BOXES = [("north", 54.0, 55.5, -2.5, -1.0), ("south", 50.5, 51.75, -1.25, 0.25), ("isles", 57.0, 58.0, -7.5, -6.25)]

_FRACTION = "CAST('0x' || substr(md5(c_custkey || '/{}/7'), 1, 8) AS BIGINT) / 4294967296.0"


@query("assigned_locations", f"""
WITH drawn AS (SELECT c_custkey, CAST(floor({_FRACTION.format('area')} * 3) AS INT) AS i, {_FRACTION.format('lat')} AS a,
                      {_FRACTION.format('lon')} AS b FROM customer),
boxes(i, area, lat0, lat1, lon0, lon1) AS (VALUES (0, 'north', 54.0, 55.5, -2.5, -1.0), (1, 'south', 50.5, 51.75, -1.25, 0.25),
  (2, 'isles', 57.0, 58.0, -7.5, -6.25))
SELECT c_custkey, area, 'POINT (' || round(CAST(lon0 + b * (lon1 - lon0) AS DOUBLE), 6) || ' ' || round(CAST(lat0 + a * (lat1 - lat0) AS DOUBLE), 6) || ')'
  AS gen_location
FROM drawn JOIN boxes USING (i)""")
def locations(spark: SparkSession, sf: str) -> DataFrame:
    return assign_location(table(spark, sf, "customer").select("c_custkey"), "c_custkey", BOXES, seed=7)
