"""Logged conversations: those that a longer one begins with go, the rest is rendered.

A log that saves a conversation after every turn holds it many times over, each
time a little longer.  Such snapshots are found by rolling hashes of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.common import cut, join_same

#: Turns that are numbered, hashed and rendered together.
RUN = 256


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def turn_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at (1, 2, ...), role, text, and ``h1``, ``h2``: hashes of the turns up to it.

    A turn's hash covers its place, role and text; xor of the hashes from the first
    on is the prefix's (128 bits).  Turns are dealt by conversation and run of turn
    numbers, and runs are tied together by their counts and xors, so that a
    conversation with a third of all rows isn't one task's.
    """
    null_role, null_text = F.col(role).isNull(), F.col(text).isNull()
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
        F.floor(F.col(turn) / RUN).alias("run"),
        F.xxhash64(F.lit(1), role, null_role, text, null_text).alias("g1"),
        F.xxhash64(F.lit(2), text, null_text, role, null_role).alias("g2"),
    )
    inside = Window.partitionBy("conv", "run").orderBy(F.col("turn").asc_nulls_first(), "g1", "g2")
    rows = rows.withColumn("nth", F.row_number().over(inside))
    sizes = rows.groupBy("conv", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    keys = ["conv", "run"]
    placed = join_same(rows, starts, keys).select(*keys, (F.col("start") + F.col("nth")).alias("at"), "role", "text", "g1", "g2")
    upto = Window.partitionBy("conv", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hashed = placed.select(
        "conv", "run", "at", "role", "text",
        *[F.bit_xor(F.xxhash64("at", g)).over(upto).alias(h) for g, h in (("g1", "x1"), ("g2", "x2"))],
    )
    sums = placed.groupBy("conv", "run").agg(*[F.bit_xor(F.xxhash64("at", g)).alias(h) for g, h in (("g1", "x1"), ("g2", "x2"))])
    carried = sums.select("conv", "run", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))])
    prefix = [F.col(x).bitwiseXOR(F.col(c)).alias(h) for x, c, h in (("x1", "c1", "h1"), ("x2", "c2", "h2"))]
    return join_same(hashed, carried, keys).select("conv", "at", "role", "text", *prefix)


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv, n_turns, n_copies of the conversations that no longer one begins with.

    Of equal ones the least ``conv`` stays, and ``n_copies`` counts them all.
    """
    lengths = hashed.groupBy("conv").agg(F.max("at").alias("n"))
    sized = join_same(hashed, lengths, ["conv"])
    whole = sized.filter("at = n").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    inner = sized.filter("at < n").select(F.col("at").alias("n"), "h1", "h2")
    return whole.join(inner.distinct(), ["n", "h1", "h2"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_copies")


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, part, n_turns, n_copies, text: maximal conversations, rendered.

    ``text`` holds up to ``RUN`` turns, and the parts of a conversation joined in
    order are its whole text; nearly all have one part, 0.  Turns are taken in order of ``turn``
    (null first); equal numbers are ordered by the hash of role and text, and
    gaps don't matter.  A null role or text is rendered as empty, but isn't equal
    to an empty one.  Rows with a null conversation id make up one conversation.
    An empty table gives no rows; other columns are ignored.
    """
    hashed = turn_hashes(turns, conv, turn, role, text)
    kept = maximal_conversations(cut(hashed.select("conv", "at", "h1", "h2")))  # hashes only, read three times
    rows = join_same(hashed, kept, ["conv"]).select(
        "conv", F.floor((F.col("at") - 1) / RUN).alias("part"), "at", "n_turns", "n_copies",
        render_turn(F.col("role"), F.col("text")).alias("text"),
    )
    parts = rows.groupBy("conv", "part").agg(
        F.first("n_turns").alias("n_turns"),
        F.first("n_copies").alias("n_copies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "").alias("text"),
    )
    return parts.withColumnRenamed("conv", "conv_id")
