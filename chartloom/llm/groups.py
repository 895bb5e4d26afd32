"""Links from shared keys to groups: candidates, connected components, pairs in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from chartloom.llm.common import cut, only_wanted

#: Members of a group that one task compares with as many others.
BLOCK = 1024
#: Edges that are worth a task, and the tasks a graph gets at least.
TASK_EDGES, LEAST_TASKS = 100_000, 8
#: Rounds after which something must be wrong: each at least halves what is left.
MAX_ROUNDS = 60


def shared_key_edges(keyed: DataFrame) -> DataFrame:
    """``src``, ``dst`` (the least id of a key) of all rows ``key``, ``id`` that share a key.

    Keys of one id, nearly all, end at a pre-aggregated count; only rows of shared keys
    meet again, and AQE splits a key that has very many.  Rows may be repeated.
    """
    held = keyed.groupBy("key").agg(F.min("id").alias("dst"), F.max("id").alias("high")).filter("dst < high")
    held = cut(held.select("key", "dst"))
    rest = only_wanted(keyed, F.col("key"), held, "key").join(held, "key").filter("id > dst")
    return rest.select(F.col("id").alias("src"), "dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its least id) of every node of an undirected graph.

    Stars in turn: first every larger neighbour of a node is tied to the node's least
    neighbour, then every node and its smaller neighbours to the least of them.  The
    number of rounds grows with the logarithm of a component's size; edges that are
    stars already take one.  A round is two joins and a few pre-aggregated shuffles of
    pairs of numbers, and is cut by a checkpoint; the driver sees a count and a
    checksum.  Edges of a hub are split by AQE's skew join.  Tasks are as many as the
    edges are worth, so that a small graph doesn't leave thousands of tiny files.
    """
    now = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    seen = _summary(now)
    for _ in range(MAX_ROUNDS):
        tasks = max(LEAST_TASKS, seen["n"] // TASK_EDGES)
        now = now.coalesce(tasks)
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("m", "src").alias("m"))
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst")
        down = large.coalesce(tasks).distinct()
        bottom = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(bottom, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst")
        now = cut(small.union(bottom.select("src", F.col("m").alias("dst"))).coalesce(tasks).distinct().coalesce(tasks))
        found = _summary(now)
        if seen == found:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct())


def _summary(edges: DataFrame) -> Row:
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()


def in_blocks(grouped: DataFrame, block: int = BLOCK) -> DataFrame:
    """``grouped`` (id, component) with the number of ``blocks`` that its component is dealt in."""
    sizes = grouped.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return grouped.join(sizes, "component")


def _met(members: DataFrame) -> DataFrame:
    """``members`` (component, blocks, id, ...) once for each two blocks of their component, which end up in one task, in order."""
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *members.columns,
        F.least("mine", "other").alias("low"),
        F.greatest("mine", "other").alias("high"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
    )
    # Sorted partitions are read as one stream: most groups are pairs, too small for a batch each.
    return met.repartition(*WHERE).sortWithinPartitions(*WHERE)


WHERE = ["component", "low", "high"]


def compare_groups(members: DataFrame, compare: Callable[[pa.Table, bool], pa.Table], schema: str) -> DataFrame:
    """``compare`` on all pairs of members of a component, block by block.

    ``members``: component, blocks, id and what ``compare`` needs.  Every two blocks
    of a component, and each with itself, meet in one task.  ``compare`` gets their
    rows with a column ``side`` (0 or 1; all 0 where a block meets itself) and whether
    to compare across sides only; it returns per-member rows, never pairs.
    """

    def one_by_one(rows: pa.Table, ends: list[int]) -> pa.Table:
        across = (rows.column("low").to_numpy() != rows.column("high").to_numpy()).tolist()
        return pa.concat_tables([compare(rows.slice(low, high - low), across[low]) for low, high in zip([0, *ends], ends)])

    return compare_many(members, one_by_one, schema)


def compare_many(members: DataFrame, compare: Callable[[pa.Table, list[int]], pa.Table], schema: str) -> DataFrame:
    """Like ``compare_groups``; ``compare`` gets the rows of many pairs of blocks at once, and where each ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # one pair of blocks at most, whose end isn't read yet
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            ends = _ends(rows)
            if ends:
                yield from compare(rows.slice(0, ends[-1]), ends).combine_chunks().to_batches()
            held = rows.slice(ends[-1] if ends else 0)
        if held is not None and len(held):
            yield from compare(held, [len(held)]).combine_chunks().to_batches()

    return _met(members).mapInArrow(run, schema)


def _ends(rows: pa.Table) -> list[int]:
    """Places in ``rows`` that another group begins at."""
    new = np.zeros(len(rows), dtype=bool)
    for name in WHERE:
        values = rows.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new).tolist()
