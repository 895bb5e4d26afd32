"""Near-duplicates by SimHash fingerprints, linked by a binary trie joined with itself.

A fingerprint takes the majority of each bit over the hashes of a text's word shingles.
The trie's paths are the different fingerprints, highest bit first.  Two copies of it
are walked together: a pair of nodes carries the bits in which their paths differ, goes
on to the four pairs of their children, and ends as soon as those bits exceed the error
budget.  Spark walks the upper levels as a table of node pairs, a few bits a round, until
both nodes of a pair hold few fingerprints; such a pair is walked to its leaves in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import cut, free_name
from chartloom.llm.groups import components

#: Words of a shingle, and the seed of its hash.
SIZE, SEED = 3, 42
#: Differing bits at which two fingerprints still link.
BUDGET = 2
BITS = 64
#: Levels of the trie that a round of joins goes down.
STRIDE = 4
#: Fingerprints under two nodes that one task walks on with.
LEAF = 1 << 15
#: Node pairs that a task holds of one level; more go in turns.
WALKED = 1 << 18
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z folded, a piece at a time; a word is never cut."""
    low = 0
    while low < len(text):
        high = low + PIECE
        while high < len(text) and text[high] not in b" \t\n\v\f\r":
            high += 1
        yield text[low:high].lower().split()
        low = high


def fingerprint(text: bytes | None, size: int = SIZE, seed: int = SEED) -> int:
    """The bits set in over half the hashes of a text's shingles; 0 without words.

    Shingles are runs of ``size`` words joined by a blank, repeats included; a text of
    fewer words has one of all its words.
    """
    ones, n, held = np.zeros(BITS, dtype=np.int64), 0, []
    for words in word_pieces(text or b""):
        held = [*held, *words]
        if len(held) >= size:
            hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed) for s in zip(*(held[k:] for k in range(size)))]
            ones += _bits_set(np.array(hashes, dtype=np.uint64))
            n += len(hashes)
            held = held[len(held) - size + 1 :]
    if not n and held:
        ones, n = _bits_set(np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], dtype=np.uint64)), 1
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def _bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest first."""
    total = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low : low + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "code", size: int = SIZE, seed: int = SEED) -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` (64 bits as a long), in place of the text."""
    kept = [c for c in df.columns if c not in (text_col, out_col)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.binary())
            codes = np.array([fingerprint(t.as_py(), size, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(codes.view(np.int64))], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`")).mapInArrow(run, schema)


def prefix(code: Column, depth: int) -> Column:
    """The path from the root to the node of this depth; in two steps, as a shift by all 64 bits is none."""
    half = (BITS - depth) // 2
    return F.shiftrightunsigned(F.shiftrightunsigned(code, half), BITS - depth - half)


def node_pairs(codes: DataFrame, budget: int = BUDGET, stride: int = STRIDE, leaf: int = LEAF) -> list[tuple[int, DataFrame]]:
    """Pairs of nodes (u, v with u <= v) whose fingerprints may link, by the depth at which they are small enough.

    ``codes``: different fingerprints.  Each round joins the pairs that are still too
    large with the children of both nodes and drops those beyond the budget.  A hot
    prefix is a large node and so split until its nodes are small: what a task gets is
    bounded whatever the fingerprints look like.  The driver sees only whether any are left.
    """

    def nodes(depth: int) -> DataFrame:
        return codes.groupBy(prefix(F.col("code"), depth).alias("node")).agg(F.count("*").alias("n"))

    root = nodes(0)
    pairs = cut(root.select(F.col("node").alias("u"), F.col("node").alias("v"), F.col("n").alias("nu"), F.col("n").alias("nv"), F.lit(0).alias("err")))
    done, depth = [], 0
    while True:
        small = (F.col("nu") + F.when(F.col("u") == F.col("v"), 0).otherwise(F.col("nv")) <= leaf) | F.lit(depth == BITS)
        done.append((depth, pairs.filter(small).select("u", "v", "err")))
        large = pairs.filter(~small)
        if depth == BITS or large.isEmpty():
            return done
        depth += stride
        below = cut(nodes(depth)).withColumn("above", F.shiftrightunsigned("node", stride))
        left = below.select(F.col("above").alias("u"), F.col("node").alias("cu"), F.col("n").alias("nu"))
        right = below.select(F.col("above").alias("v"), F.col("node").alias("cv"), F.col("n").alias("nv"))
        down = large.drop("nu", "nv").join(left, "u").join(right, "v")
        down = down.withColumn("err", F.col("err") + F.bit_count(F.col("cu").bitwiseXOR(F.col("cv"))) - F.bit_count(F.col("u").bitwiseXOR(F.col("v"))))
        down = down.filter((F.col("err") <= budget) & ((F.col("u") != F.col("v")) | (F.col("cu") <= F.col("cv"))))
        pairs = cut(down.select(F.col("cu").alias("u"), F.col("cv").alias("v"), "nu", "nv", "err"))


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, err: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of the linked fingerprints under two nodes; ``b`` None: under one, each pair once.

    Both are sorted, of no repeats, so that a node is a range of places and a bit splits
    it in two.  A level's pairs are arrays; when they are many they are walked in turns.
    """
    other = a if b is None else b
    # Ones of each bit before each place: a range's zeros come first.
    before = [_ones_before(a), _ones_before(other)]
    todo = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(other), err)))]
    while todo:
        level, alo, ahi, blo, bhi, errs = todo.pop()
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if level == BITS or single.any():
            i, j = alo[single], blo[single]
            near = np.bitwise_count(a[i] ^ other[j]) <= budget
            if b is None:
                near &= i != j
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, errs = (x[~single] for x in (alo, ahi, blo, bhi, errs))
        if not len(alo):
            continue
        if len(alo) > WALKED:
            for low in range(0, len(alo), WALKED):
                todo.append((level, *(x[low : low + WALKED] for x in (alo, ahi, blo, bhi, errs))))
            continue
        ones_a, ones_b = before[0](level), before[1](level)
        amid = ahi - (ones_a[ahi] - ones_a[alo])
        bmid = bhi - (ones_b[bhi] - ones_b[blo])
        same = (alo == blo) & (ahi == bhi) if b is None else np.zeros(len(alo), bool)
        cross = ~same
        down = [
            (alo, amid, blo, bmid, errs),
            (amid, ahi, bmid, bhi, errs),
            (alo, amid, bmid, bhi, errs + 1),
            tuple(x[cross] for x in (amid, ahi, blo, bmid, errs + 1)),
        ]
        joined = [np.concatenate(x) for x in zip(*down)]
        keep = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget)
        todo.append((level + 1, *(x[keep] for x in joined)))


def _ones_before(codes: np.ndarray):  # noqa: ANN202
    """A function of a level: how many fingerprints before each place have its bit."""
    held: dict[int, np.ndarray] = {}

    def at(level: int) -> np.ndarray:
        if level not in held:
            bit = (codes >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            held[level] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
        return held[level]

    return at


def _joined_labels(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least place that each of ``n`` places is connected with."""
    label = np.arange(n)
    for i, j in links:
        while True:
            low = np.minimum(label[i], label[j])
            if np.array_equal(label[i], low) and np.array_equal(label[j], low):
                break
            # What a place stood for follows it, so that earlier links stay connected.
            for at in (label[i], label[j]):
                np.minimum.at(label, at, low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while not np.array_equal(label, label[label]):
                label = label[label]
    return label


def trie_links(codes: DataFrame, budget: int = BUDGET, stride: int = STRIDE, leaf: int = LEAF) -> DataFrame:
    """``src``, ``dst``: edges that connect all fingerprints (column ``code``, no repeats) within the budget.

    A task gives at most one edge a fingerprint, to the least one it is connected with
    there, not all links: these connect the same fingerprints.
    """
    parts = None
    for depth, pairs in node_pairs(codes, budget, stride, leaf):
        at = codes.withColumn("node", prefix(F.col("code"), depth))
        key = [F.lit(depth).alias("depth"), "u", "v", "err"]
        mine = at.join(pairs, F.col("node") == F.col("u")).select(*key, F.lit(0).alias("side"), "code")
        theirs = at.join(pairs.filter("u <> v"), F.col("node") == F.col("v")).select(*key, F.lit(1).alias("side"), "code")
        both = mine.union(theirs)
        parts = both if parts is None else parts.union(both)

    def run(table: pa.Table) -> pa.Table:
        depth, err = (table.column(c)[0].as_py() for c in ("depth", "err"))
        side = table.column("side").to_numpy()
        held = table.column("code").to_numpy().view(np.uint64)
        a, b = np.sort(held[side == 0]), np.sort(held[side == 1])
        crossed = len(b) > 0
        links = walk(a, b if crossed else None, depth, err, budget)
        whole = np.concatenate([a, b])
        label = _joined_labels(len(whole), ((i, j + len(a) if crossed else j) for i, j in links))
        tied = np.flatnonzero(label != np.arange(len(whole)))
        return pa.table({"src": whole[tied].view(np.int64), "dst": whole[label[tied]].view(np.int64)})

    return parts.groupBy("depth", "u", "v").applyInArrow(run, "src long, dst long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, seed: int = SEED, budget: int = BUDGET
) -> DataFrame:
    """One row per row of ``df``: its id, ``code`` (fingerprint as a long) and ``component_id``.

    ``component_id`` is the least id of the rows reachable by links of ``budget`` or
    fewer differing bits, the row's own included; null where none of them has an id.
    Null and empty texts and those without words have fingerprint 0 and link like any
    other.  Rows with one fingerprint are one node, however many they are; repeated rows
    and ids are such.  Other columns of ``df`` are ignored.  An empty table gives no rows.

    Fingerprints are computed once and written; 8 bytes a different one are shuffled for
    each node pair it is in, then 16 bytes a row for the join, whose hot keys AQE splits.
    """
    id_ = free_name(df.select(text_col), "id")
    coded = cut(fingerprints(df.select(df[id_col].alias(id_), df[text_col].alias(text_col)), text_col, "code", size, seed))
    nodes = cut(coded.groupBy("code").agg(F.min(id_).alias("first")))
    linked = components(trie_links(nodes.select("code"), budget)).withColumnsRenamed({"id": "code", "component": "root"})
    some = cut(nodes.join(linked, "code"))
    least = some.groupBy("root").agg(F.min("first").alias("component_id"))
    joined = some.join(least, "root").select("code", "component_id")
    known = nodes.join(joined.withColumn("tied", F.lit(True)), "code", "left")
    known = known.select("code", F.when(F.col("tied"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    return coded.join(known, "code").select(F.col(id_).alias(id_col), "code", "component_id")


def as_hex(code: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(code), 16, "0"))
