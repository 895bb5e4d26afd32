"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import checkpoint_folder

#: ASCII letters; texts are folded with these alone, so that every engine folds alike.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether a run's shuffle files go when it ends, or when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: its lineage ends.

    What was shuffled on the way is deleted at once: nothing reads it any more.
    """
    conf = df.sparkSession.conf
    checkpoint_folder(df.sparkSession)
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        # A frame takes the setting of the time it is made.
        return df.select("*").checkpoint()
    finally:
        conf.unset(TIDY) if before is None else conf.set(TIDY, before)


def ship(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """``value`` broadcast with the classes it is made of; call what is returned once in a task.

    A broadcast alone names classes, and executors have none of this package installed.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` computed once.

    A column that a lambda captures is worked out again for each element; a
    lambda's own variable is not, so the value is bound to one.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Lower-case A-Z and leave all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where null equals null; the right side's keys aren't repeated."""
    named = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = [F.expr(f"`{k}` <=> `{k}__r`") for k in keys]
    return left.join(named, on, how).drop(*[f"{k}__r" for k in keys])


#: Bits of the map that ``only_wanted`` broadcasts: 262,144 rows of 64 bits, whatever the data.
MAP_BITS = 1 << 24


def _marked(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``df`` with ``__map_hit``: whether the bit of the row's key is set in the map of wanted keys."""

    def slot(k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(MAP_BITS))

    of = slot(F.col(wanted_key))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (of % 64).cast("int"))
    bits = wanted.groupBy(F.floor(of / 64).alias("__map_word")).agg(F.bit_or(bit).alias("__map_bits"))
    marked = df.withColumn("__map_slot", slot(key)).withColumn("__map_word", F.floor(F.col("__map_slot") / 64))
    found = F.call_function("shiftright", F.col("__map_bits"), (F.col("__map_slot") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    joined = marked.join(F.broadcast(bits), "__map_word", "left")
    return joined.withColumn("__map_hit", F.coalesce(found == 1, F.lit(False))).drop("__map_word", "__map_slot", "__map_bits")


def only_wanted(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df`` whose key may be among the wanted ones, before a join that shuffles them.

    Wanted keys set bits of a map of fixed size, which is broadcast; rows whose bit isn't
    set go.  Nothing wanted is lost; some other rows stay, the more the fuller the map.
    Follow it with an inner join: a semi join would be moved below the map.
    """
    return _marked(df, key, wanted, wanted_key).filter("__map_hit").drop("__map_hit")


def split_wanted(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the wanted ones, and those whose key isn't; see ``only_wanted``."""
    marked = _marked(df, key, wanted, wanted_key)
    return marked.filter("__map_hit").drop("__map_hit"), marked.filter("NOT __map_hit").drop("__map_hit")
