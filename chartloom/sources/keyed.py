"""Keyed tables in versions: an update rewrites the buckets it touches, readers see one version.

    <path>/data/version=3/bucket=17/...   rows whose key hashes to bucket 17, as version 3 wrote them
    <path>/manifest/version=3/...         for each bucket, the version that holds it

Data are written first and the manifest last: a job that fails leaves files nobody reads,
which the next run of the same version overwrites.  Files of older versions stay, so that
a reader goes on with the version it began with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.names import named
from chartloom.operators.ledger import upsert
from chartloom.operators.records import only

BUCKET, DATA = "_bucket", "_data_version"
#: Buckets of a new table: a bucket is rewritten as a whole by one task, so it should hold some 100 MB.
BUCKETS = 256


def _bucket(key: Column, buckets: int) -> Column:
    """Keys go by their text, so that updates may have them in another type."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifests of all versions; None where there is no table yet."""
    try:
        return spark.read.option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        return None


def latest_version(spark: SparkSession, path: str) -> int:
    """The last version that was written whole; -1 where there is none."""
    found = _versions(spark, path)
    newest = None if found is None else found.agg(F.max("version")).first()[0]
    return -1 if newest is None else newest


def _manifest(spark: SparkSession, path: str, version: int) -> tuple[dict[int, int], str, int]:
    """Where each bucket is, the key, and the number of buckets: one row a bucket."""
    rows = _versions(spark, path).filter(F.col("version") == version).collect()
    if not rows:
        raise ValueError(f"{path} has no version {version}")
    return {r[BUCKET]: r[DATA] for r in rows if r[DATA] is not None}, rows[0]["key"], rows[0]["buckets"]


def _schema_of(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/schema/version={version}")


def _read(spark: SparkSession, path: str, version: int, held: dict[int, int]) -> DataFrame:
    empty = _schema_of(spark, path, version)
    if not held:
        return empty
    folders = [f"{path}/data/version={v}/{BUCKET}={b}" for b, v in sorted(held.items())]
    return spark.read.schema(empty.schema).parquet(*folders)


def read_keyed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default.  Only the files of that version are listed and read."""
    version = latest_version(spark, path) if version is None else version
    return _read(spark, path, version, _manifest(spark, path, version)[0])


def create_keyed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Write ``df`` as version 0 of a new table; rows of one key are all kept."""
    if latest_version(df.sparkSession, path) >= 0:
        raise ValueError(f"{path} holds a table already")
    _publish(df, path, 0, {}, None, key, buckets)
    return 0


def upsert_keyed(updates: DataFrame, path: str, order_col: str) -> int:
    """The last update of each key over the table's row; the new version's number.

    Only buckets with updates are read and rewritten; the others stay in the version that
    holds them.  A column that the updates lack is null in the rows they write.  Rows
    without a key are never replaced.  No update gives a new version of the same files.
    """

    def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
        return upsert(old, new, key, order_col)

    return _change(updates, path, merged)


def replace_keyed(updates: DataFrame, path: str) -> int:
    """All rows of ``updates`` in place of all rows of their keys: for keys of many rows, such as the file rows came from."""

    def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
        keys = new.select(named(key).cast("string").alias("_k")).distinct()
        kept = old.join(keys, named(key).cast("string").eqNullSafe(F.col("_k")), "left_anti")
        return kept.unionByName(new, allowMissingColumns=True)

    return _change(updates, path, merged)


def _change(updates: DataFrame, path: str, merged) -> int:  # noqa: ANN001
    spark = updates.sparkSession
    version = latest_version(spark, path)
    if version < 0:
        raise ValueError(f"{path} holds no table yet")
    held, key, buckets = _manifest(spark, path, version)
    # As many numbers as there are buckets, at most.
    found = updates.select(_bucket(named(key), buckets).alias(BUCKET)).distinct().collect()
    touched = {r[BUCKET] for r in found}
    old = _read(spark, path, version, {b: v for b, v in held.items() if b in touched})
    _publish(merged(old, updates.select(*only(updates, updates.columns)), key), path, version + 1, held, touched, key, buckets)
    return version + 1


def _publish(rows: DataFrame, path: str, version: int, held: dict[int, int], touched: set[int] | None, key: str, buckets: int) -> None:
    """Write the touched buckets, then what columns there are, then the manifest that makes them the version."""
    spark = rows.sparkSession
    placed = rows.withColumn(BUCKET, _bucket(named(key), buckets))
    # A bucket is one file, unless it is a hot key's: AQE splits that.
    placed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/version={version}")
    try:
        written = spark.read.parquet(f"{path}/data/version={version}").select(BUCKET).distinct().collect()
    except Exception as exc:  # no rows, so no bucket
        if "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        written = []
    if touched is not None and not {r[BUCKET] for r in written} <= touched:
        raise RuntimeError("the updates are not the same when they are read again: store them first")
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/schema/version={version}")
    now = {b: v for b, v in held.items() if touched is not None and b not in touched} | {r[BUCKET]: version for r in written}
    entries = [(b, v, key, buckets) for b, v in sorted(now.items())] or [(0, None, key, buckets)]
    manifest = spark.createDataFrame(entries, f"{BUCKET} int, {DATA} int, key string, buckets int")
    # Two writers of one version: the second fails here and changes nothing.
    manifest.coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")


def file_marks(df: DataFrame, file_col: str) -> DataFrame:
    """``file`` and ``mark`` of each input file: a checksum of its rows, whatever their order."""
    others = [c for c in df.columns if c != file_col]
    row = F.xxhash64(F.to_json(F.struct(*only(df, others)))).cast("decimal(38,0)")
    return df.groupBy(named(file_col).alias("file")).agg(F.concat_ws("-", F.count("*"), F.sum(row)).alias("mark"))


def merge_files(partials: DataFrame, marks: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Put the partial results of input files in a table of them; the version that holds them.

    ``partials`` has ``file`` and the partial result's columns, ``marks`` a row for each file
    read (``file_marks``).  A file whose mark the table has already is passed over, so that a
    file merged twice counts once; one that comes with another mark replaces all it gave
    before, so that counts go down and first times are found anew; one that no longer gives
    anything takes its share away.  ``merged_partials`` adds up what is there.
    """
    spark = partials.sparkSession
    rows = partials.join(marks, "file", "right")  # a file without results is a row of nulls
    if latest_version(spark, path) < 0:
        return create_keyed(rows, path, "file", buckets)
    known = read_keyed(spark, path).select("file", "mark").distinct()
    changed = rows.join(known, ["file", "mark"], "left_anti")
    return replace_keyed(changed.select(*only(rows, rows.columns)), path)


def merged_partials(spark: SparkSession, path: str, keys: tuple[str, ...] = ("cui", "patient"), version: int | None = None) -> DataFrame:
    """Counts added and first times taken over all files: ``keys``, ``n``, ``first_seen``."""
    rows = read_keyed(spark, path, version).filter(F.coalesce(*[named(k).cast("string") for k in keys]).isNotNull())
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.nullif("first_seen", F.lit(0))).alias("first_seen"))
