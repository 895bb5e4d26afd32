"""Terms and phrases by an index in files, so that a search reads the postings it needs and no text.

A posting is a term, a document and the places of the term in it.  Postings lie in Parquet
by segment and bucket (of the term's hash), sorted by term: a search names its buckets and
terms, so that Spark prunes folders and row groups.  Documents that come later are a
segment more; nothing is rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.functions.names import named

MARKS = r"[^\p{L}\p{N}]+"
BUCKETS = 64


def words(text: Column) -> Column:
    """The words of a text as ``match_text`` takes them apart: letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), MARKS), lambda w: w != "")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id``, ``text_key``, ``words`` to a row for each different word of a row, with its places in order."""
    for batch in batches:
        counts = batch.column(2).value_lengths().to_numpy()
        coded = batch.column(2).flatten().dictionary_encode()
        row = np.repeat(np.arange(len(counts)), counts)
        key = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        places = pa.ListArray.from_arrays(pa.array([*first, len(row)], pa.int32()), pa.array(place[order], pa.int32()))
        one = order[first]
        mine = pa.array(row[one])
        columns = [coded.dictionary.take(coded.indices.take(pa.array(one))), batch.column(0).take(mine), batch.column(1).take(mine), places]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "text_key", "places"])


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket``, ``term``, ``id``, ``text_key``, ``places`` (ascending): a row for each term of each row's text.

    ``text_key`` is the text's hash: it tells rows of one id apart and postings of a text
    that has changed since.  Places of a document are put together where it was read, and
    nothing is shuffled; rows that are equal in id and text have equal postings.
    """
    found = df.select(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("text_key"), words(named(text_col)).alias("words")).filter(F.size("words") > 0)
    schema = T.StructType([
        T.StructField("term", T.StringType()), found.schema["id"], found.schema["text_key"],
        T.StructField("places", T.ArrayType(T.IntegerType())),
    ])
    return found.mapInArrow(_by_term, schema).select(_bucket(F.col("term")).alias("bucket"), "term", "id", "text_key", "places")


def write_text_index(df: DataFrame, id_col: str, text_col: str, path: str, segment: str) -> None:
    """Add the postings of ``df`` as one segment; a segment of that name is overwritten, so that a rerun adds nothing.

    A task writes the postings of the texts it read, a file for each bucket, sorted by
    term and document: a text's postings never move, and a term that every document has is
    several tasks'.  A segment shows when all of it is written.
    """
    order = ["bucket", "term", "id", "text_key"]
    postings(df, id_col, text_col).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path.rstrip('/')}/segment={segment}"
    )


def _wanted(spark: SparkSession, terms: Sequence[str]) -> tuple[list[list[str]], list[int]]:
    """Each term as its words, and the buckets of all words: worked out as the index's were."""
    rows = spark.range(1).select(F.array(*[words(F.lit(t)) for t in terms]).alias("w"))
    rows = rows.withColumn("b", F.transform(F.flatten("w"), _bucket))
    found = rows.first()
    return found["w"], sorted(set(found["b"]))


def search_index(spark: SparkSession, path: str, terms: Sequence[str], every: bool = False) -> DataFrame:
    """``id``, ``text_key`` of the texts with one of the terms, or with ``every`` all of them.

    A term of several words is a phrase: its words have to follow one another, which the
    places tell.  A term without a word is in no text.
    """
    wanted, buckets = _wanted(spark, terms)
    needed = sorted({w for phrase in wanted for w in phrase})
    index = spark.read.option("basePath", path).parquet(path)
    rows = index.filter(F.col("bucket").isin(buckets) & F.col("term").isin(needed)).select("term", "id", "text_key", "places")
    # A text that is held again, in its segment or another, has the same places.
    places = [F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"w{i}") for i, w in enumerate(needed)]
    texts = rows.groupBy("id", "text_key").agg(*places) if needed else rows.select("id", "text_key").limit(0)
    hits = [_follows([F.col(f"w{needed.index(w)}") for w in phrase]) if phrase else F.lit(False) for phrase in wanted]
    found = F.lit(every)
    for hit in hits:
        found = found & hit if every else found | hit
    return texts.filter(found).select("id", "text_key")


def _follows(places: list[Column]) -> Column:
    """Whether some place of the first word has the others right behind it."""

    def back(held: Column, steps: int) -> Column:
        return F.transform(held, lambda place: place - steps)

    starts = places[0]
    for i, held in enumerate(places[1:], 1):
        starts = F.array_intersect(starts, back(held, i))
    return F.coalesce(F.size(starts) > 0, F.lit(False))


def match_indexed(df: DataFrame, path: str, id_col: str, text_col: str, terms: Sequence[str], every: bool = False) -> DataFrame:
    """The rows of ``match_text``, found by the index instead of the texts.

    Rows that aren't in the index, and rows whose text has changed since, are not found.
    """
    if not terms:
        return df if every else df.limit(0)
    hits = search_index(df.sparkSession, path, terms, every).withColumnsRenamed({"id": "_hit_id", "text_key": "_hit_key"})
    same = named(id_col).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(named(text_col)) == F.col("_hit_key"))
    return df.join(hits, same, "left_semi")
