"""Writers.  All of them overwrite their own path, so a rerun gives the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions.names import named
from chartloom.operators.cohort import MAP_ENTRIES, to_nested_map
from chartloom.operators.ledger import upsert
from chartloom.operators.records import json_column, part_of, to_ndjson
from chartloom.sources.records import require_avro


def write_ndjson(df: DataFrame, path: str, max_records: int | None = None) -> None:
    """One compact JSON object per line."""
    writer = to_ndjson(df).write.mode("overwrite")
    (writer.option("maxRecordsPerFile", max_records) if max_records else writer).text(path)


def dict_json(df: DataFrame, key: str, value: str, parts: int = 1) -> DataFrame:
    """``{key: value}`` objects: ``part, value``, keys in order.

    ``parts=1`` is one object with every key, for artefacts known to be small.  A
    big one takes more parts, each holding the keys of one hash range; no key is
    in two parts, so reading all of them gives the one dictionary.
    """
    entry = F.struct(named(key).cast("string").alias("k"), named(value).alias("v"))
    part = part_of(named(key), F.lit(parts))
    grouped = df.groupBy(part.alias("part")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return grouped.select("part", F.to_json("m", {"ignoreNullFields": "false"}).alias("value"))


def write_dict_json(df: DataFrame, key: str, value: str, path: str, max_entries: int | None = None) -> None:
    """Write one ``{key: value}`` object.

    More than ``MAP_ENTRIES`` keys don't fit one: that is an error, before anything is
    written.  ``max_entries`` asks for parts: objects of at most about so many keys each,
    which add up to the whole.
    """
    n = df.count()  # one number
    if max_entries is None and n > MAP_ENTRIES:
        raise ValueError(f"{n} keys do not fit one object; ask for parts with max_entries")
    parts = 1 if max_entries is None else -(-max(n, 1) // max_entries)
    dict_json(df, key, value, parts).select("value").write.mode("overwrite").text(path)


def dict_jsonl(df: DataFrame, outer: str, inner: str, value: str, max_entries: int | None = None) -> DataFrame:
    """JSON lines ``{outer: {inner: value}}``, one per outer key; with ``max_entries`` a hot key takes several, see ``to_nested_map``."""
    nested = to_nested_map(df, outer, inner, value, max_entries)
    line = F.create_map(named(outer).cast("string"), F.col("entries"))
    return nested.select(named(outer), "part", F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))


def write_dict_jsonl(df: DataFrame, outer: str, inner: str, value: str, path: str, max_entries: int | None = None) -> None:
    """Write the lines of ``dict_jsonl``."""
    dict_jsonl(df, outer, inner, value, max_entries).select("value").write.mode("overwrite").text(path)


def write_avro(df: DataFrame, path: str) -> None:
    """Avro files with the schema of the frame; needs spark-avro."""
    require_avro(df.sparkSession)
    df.write.format("avro").mode("overwrite").save(path)


def write_split(df: DataFrame, path: str, max_records: int, fmt: str = "parquet") -> None:
    """Files of at most ``max_records`` records."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_records).format(fmt).save(path)


def write_upsert(target: DataFrame, updates: DataFrame, key: str, order_col: str, out_path: str) -> DataFrame:
    """Write the next version of a keyed table to a folder of its own and return it.

    The version being read is never overwritten: a failed job leaves it whole.
    """
    upsert(target, updates, key, order_col).write.mode("overwrite").parquet(out_path)
    return target.sparkSession.read.parquet(out_path)


def write_failures(failed: DataFrame, path: str, step: str = "") -> None:
    """Failed records beside the main output: ``step, error, record`` (JSON), in a folder of the step's own.

    A rerun of the step overwrites what it wrote before; ``spark.read.json(path)`` reads
    the failures of all steps.
    """
    failure_rows(failed, step).write.mode("overwrite").json(f"{path.rstrip('/')}/of_step={step or 'none'}")


def failure_rows(failed: DataFrame, step: str = "") -> DataFrame:
    """Failed records of any shape in one shape."""
    record = failed.drop("error")
    return failed.select(F.lit(step).alias("step"), F.col("error"), json_column(record).alias("record"))
