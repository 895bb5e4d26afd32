"""Documents with much the same word n-grams: MinHash bands, then exact Jaccard similarity.

Texts with equal n-gram sets are one class.  Classes that share a band are candidates;
within a connected group of candidates all pairs are verified on full n-gram sets, in
blocks, and only counts and labels leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import cut, free_name, join_same, only_wanted
from chartloom.llm.groups import compare_groups, components, in_blocks, shared_key_edges
from chartloom.llm.words import Scanner, mix, shingles

SIZE = 5
#: Similarity as a fraction of whole numbers, so that a tie is a link.
SIMILARITY = (4, 5)
RECALL = 0.999
SEED = 7_919
#: Text bytes hashed at once.
BYTES = 1 << 20
#: Columns of the membership matrix held at once.
COLUMNS = 2048


def bands_for(similarity: float, recall: float, rows: int = 5) -> int:
    """Bands of ``rows`` hashes so that a pair of this similarity shares one with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, size=(2, n), dtype=np.uint64)
    return made[0] | np.uint64(1), made[1]


def _sets(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams without repeats in a text, ordered by text."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def signatures(df: DataFrame, text_col: str, bands: int, rows: int, size: int) -> DataFrame:
    """``df`` without its text, with n_grams, k1, k2 (128 bits of the n-gram set) and ``bands`` (hashes)."""
    kept = [c for c in df.columns if c != text_col]
    added = [("n_grams", T.LongType()), ("k1", T.LongType()), ("k2", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t in added]])
    place = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, (a, b) = Scanner(), _hash_functions(bands * rows)
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            for low, high in slices(texts, BYTES):
                n = high - low
                hashes, owner = _sets(*shingles(scanner.scan(texts.slice(low, n).to_pylist()), size))
                counts = np.bincount(owner, minlength=n)
                full = np.flatnonzero(counts)
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1][full]
                least = np.empty((len(full), bands * rows), dtype=np.uint64)
                keys = np.zeros((2, n), dtype=np.uint64)
                if len(full):
                    for j in range(bands * rows):
                        least[:, j] = np.minimum.reduceat(mix_one(hashes, a[j], b[j]), starts)
                    for k in range(2):
                        keys[k, full] = mix(np.add.reduceat(mix(hashes + np.uint64(k + 1)), starts) + counts[full].astype(np.uint64))
                banded = np.zeros((len(full), bands), dtype=np.uint64)
                for r in range(rows):
                    banded = mix(banded * np.uint64(0x2545F4914F6CDD1D) + least[:, r::rows])
                banded = mix(banded + np.arange(1, bands + 1, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]), pa.int32()),
                    pa.array(banded.reshape(-1).view(np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(low, n).columns[:place], pa.array(counts, pa.int64()), *[pa.array(k.view(np.int64)) for k in keys], lists],
                    names=schema.names,
                )

    return df.select(*[df[c] for c in kept], df[text_col]).mapInArrow(run, schema)


def mix_one(hashes: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """One more hash of hashes: multiply and fold the upper half in."""
    x = hashes * a + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text; a longer text alone."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    low = total = 0
    for k, n in enumerate(lengths.tolist()):
        total += n
        if total >= size:
            yield low, k + 1
            low, total = k + 1, 0
    if low < len(lengths):
        yield low, len(lengths)


def overlaps(first: tuple[np.ndarray, np.ndarray], n_first: int, second: tuple[np.ndarray, np.ndarray], n_second: int) -> np.ndarray:
    """How many n-grams each of the first texts shares with each of the second.

    Only n-grams of two texts or more can be shared; they become columns of 0 and 1,
    a block at a time, and a product of matrices counts.
    """
    total = np.zeros((n_first, n_second), dtype=np.float32)
    common = np.intersect1d(first[0], second[0])
    parts = []
    for hashes, owner in (first, second):
        at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
        hit = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
        order = np.argsort(at[hit], kind="stable")
        parts.append((at[hit][order], owner[hit][order]))
    for low in range(0, len(common), COLUMNS):
        made = []
        for (at, owner), n in zip(parts, (n_first, n_second), strict=True):
            s, e = np.searchsorted(at, [low, low + COLUMNS])
            dense = np.zeros((n, min(COLUMNS, len(common) - low)), dtype=np.float32)
            dense[owner[s:e], at[s:e] - low] = 1
            made.append(dense)
        total += made[0] @ made[1].T
    return total


def _verified(size: int, similarity: tuple[int, int]):  # noqa: ANN202
    """A comparison for ``compare_groups``: links and labels of the members, by exact similarity."""

    def compare(rows: pa.Table, across: bool) -> pa.Table:
        rows = rows.combine_chunks()
        ids = rows.column("id").to_numpy()
        side = rows.column("side").to_numpy()
        scan = Scanner().scan(rows.column("text").cast(pa.binary()).to_pylist())
        hashes, owner = _sets(*shingles(scan, size))
        counts = np.bincount(owner, minlength=len(ids))
        lefts = np.flatnonzero(side == 0)
        rights = np.flatnonzero(side == 1) if across else lefts
        number = np.zeros(len(ids), dtype=np.int64)
        number[lefts] = np.arange(len(lefts))
        number[rights] = np.arange(len(rights))
        sets = []
        for mine in (lefts, rights):
            chosen = np.isin(owner, mine)
            sets.append((hashes[chosen], number[owner[chosen]]))
        shared = overlaps(sets[0], len(lefts), sets[1], len(rights)).astype(np.int64)
        union = counts[lefts][:, None] + counts[rights][None, :] - shared
        linked = shared * similarity[1] >= union * similarity[0]
        if not across:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), dtype=np.int64)
        links[lefts] += linked.sum(axis=1)
        if across:
            links[rights] += linked.sum(axis=0)
        label = spread_least(ids, lefts, rights, linked)
        return pa.table({"id": ids, "n_links": links, "label": label})

    return compare


def spread_least(ids: np.ndarray, lefts: np.ndarray, rights: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The least id that each member is connected with, through the links given."""
    label = ids.copy()
    while True:
        old = label.copy()
        far = np.iinfo(np.int64).max
        if len(rights) and len(lefts):
            label[lefts] = np.minimum(label[lefts], np.where(linked, label[rights][None, :], far).min(axis=1))
            label[rights] = np.minimum(label[rights], np.where(linked, label[lefts][:, None], far).min(axis=0))
        if np.array_equal(old, label):
            return label


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    similarity: tuple[int, int] = SIMILARITY,
    recall: float = RECALL,
    rows: int = 5,
) -> DataFrame:
    """One row per row of ``df``: its id, ``class_id``, ``n_links``, ``n_copies``, ``text_key`` and ``class_key``.

    ``class_id`` is the least document id of the texts connected by links; unlike texts
    without an id, or with the same one, share it, so ``class_key`` is what tells classes
    apart: the least 128 bits of the class's n-gram sets, null for a text without words;
    ``n_links`` counts the different n-gram sets whose Jaccard similarity with the
    text's is ``similarity`` or more, ``n_copies`` the rows with the same set
    (itself included); ``text_key`` is the text's 64-bit hash, which tells rows with
    one id apart.  A pair just at the threshold becomes a candidate with probability
    ``recall``, more similar ones nearly always; no pair below is ever linked.

    A text of fewer words than ``size`` has one n-gram, all its words.  A null text
    and one without words are like no other: a class of their own id, no links, one
    copy.  A null id is its class's only if the class has no other.  Repeated rows
    are copies.  An empty table gives no rows.

    Signatures (some 150 bytes a document) are shuffled by n-gram set, band hashes (24
    bytes, a few per set) by value; texts of candidates move once, and once for each
    block they meet.  A hot set or text is reduced before it is shuffled.
    """
    id_, key = "__id", "__text"
    bands = bands_for(similarity[0] / similarity[1], recall, rows)
    named = df.select(df[id_col].alias(id_), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias(key))
    signed = cut(signatures(named, "text", bands, rows, size))
    filled = signed.filter("n_grams > 0")
    first = filled.groupBy("k1", "k2").agg(
        F.count("*").alias("n_copies"), F.min_by(F.struct(id_, key, "bands"), F.struct(F.col(id_).isNull(), id_, key)).alias("rep")
    )
    classes = cut(
        first.select(
            F.monotonically_increasing_id().alias("id"), "k1", "k2", "n_copies",
            *[F.col("rep")[c].alias(c) for c in (id_, key, "bands")],
        )
    )
    edges = shared_key_edges(classes.select(F.explode("bands").alias("key"), "id"))
    grouped = in_blocks(cut(components(edges)))
    candidates = classes.select("id", id_, key).join(grouped, "id")
    texts = join_same(only_wanted(named, F.col(key), candidates, key), candidates, [id_, key]).groupBy("id", "component", "blocks").agg(F.first("text").alias("text"))
    found = cut(compare_groups(texts, _verified(size, similarity), "id long, n_links long, label long"))
    links = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    joined = components(found.select(F.col("id").alias("src"), F.col("label").alias("dst")))
    placed = (
        classes.join(links, "id", "left").join(joined, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    ids = placed.groupBy("component").agg(F.min(id_).alias("class_id"), F.min(F.struct("k1", "k2")).alias("class_key"))
    known = placed.join(ids, "component").select(
        "k1", "k2", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "class_key"
    )
    with_words = filled.join(known, ["k1", "k2"]).select(id_, "class_id", "n_links", "n_copies", key, "class_key")
    bare = signed.filter("n_grams = 0").select(
        id_, F.col(id_).alias("class_id"), F.lit(0).cast("long"), F.lit(1).cast("long"), key,
        F.lit(None).cast("struct<k1: bigint, k2: bigint>"),
    )
    return with_words.union(bare).withColumnsRenamed({id_: id_col, key: "text_key"})


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """``df`` with one row of each class: the one with the least id, then the least text hash.

    Rows without words all stay.
    """
    found = near_duplicates(df, id_col, text_col, **options).filter("class_key IS NOT NULL")
    key, lone = free_name(df, "text_key"), free_name(df, "no_words")
    bare = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    marked = df.withColumn(key, F.xxhash64(df[text_col])).withColumn(lone, bare)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("text_key"))
    best = found.groupBy("class_key").agg(F.min(order).alias("best")).select(
        F.col("best")[id_col].alias(id_col), F.col("best")["text_key"].alias(key)
    ).distinct()
    stay = join_same(marked.filter(~F.col(lone)), best, [id_col, key]).dropDuplicates([id_col, key])
    return stay.unionByName(marked.filter(lone)).select(*[F.col(f"`{c}`") for c in df.columns])
