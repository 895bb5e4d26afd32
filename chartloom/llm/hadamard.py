"""Vectors as short codes: parts of a vector by the nearest entry of a codebook, in integers.

A vector's components become integers and the vector is cut into equal parts.  Parts and
codebook entries are padded with zeros to a power of two and go through the Walsh-Hadamard
transform, which multiplies every squared distance by its length.  Squared differences are
added up in sequency order, where coefficients of few sign changes come first; an entry
whose sum so far is beyond the best one can't be the nearest and is dropped.  Additions,
subtractions and integer products do it all, so that every machine finds the same codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import free_name, join_same

#: Parts of a vector, entries of a part's codebook, and rounds that move the entries.
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Integers that a component of 1 becomes.
SCALE = 4096
#: Coefficients after which entries are dropped, as a share of all: one in so many.
STEPS = 4
#: Rows that are transformed at once.
ROWS = 4096


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows of ``x``, padded to a power of two, in sequency order."""
    width = max(1, x.shape[-1])
    size = 1 << (width - 1).bit_length()
    out = np.zeros((*x.shape[:-1], size), dtype=x.dtype)
    out[..., : x.shape[-1]] = x
    step = 1
    while step < size:
        halves = out.reshape(*x.shape[:-1], size // (2 * step), 2, step)
        sums, gaps = halves[..., 0, :] + halves[..., 1, :], halves[..., 0, :] - halves[..., 1, :]
        out = np.stack([sums, gaps], axis=-2).reshape(*x.shape[:-1], size)
        step *= 2
    return out[..., by_sequency(size)]


def by_sequency(size: int) -> np.ndarray:
    """The transform's rows by their number of sign changes: the k-th is at the reversed bits of k's Gray code."""
    bits = size.bit_length() - 1
    k = np.arange(size)
    gray, place = k ^ (k >> 1), np.zeros(size, dtype=np.int64)
    for b in range(bits):
        place |= (gray >> b & 1) << (bits - 1 - b)
    return place


def nearest(parts: np.ndarray, entries: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry for each part, the lower one of equals, and the squared distance.

    ``parts`` and ``entries`` are integers, machine words or Python's.
    """
    x, c = transform(parts), transform(entries)
    size, n = x.shape[1], len(x)
    ends = sorted({max(1, size * k // steps) for k in range(1, steps + 1)})
    rows = np.arange(n)

    def scaled(row: np.ndarray, entry: np.ndarray, low: int, high: int) -> np.ndarray:
        gap = x[row, low:high] - c[entry, low:high]
        return (gap * gap).sum(axis=1)

    first = x[:, None, : ends[0]] - c[None, :, : ends[0]]
    sums = (first * first).sum(axis=2)
    # The entry that leads so far sets the bound: its distance is worked out to the end.
    best = np.argmin(sums, axis=1)
    bound = sums[rows, best] + scaled(rows, best, ends[0], size)
    row, entry = np.nonzero(_may_win(sums, np.arange(len(c))[None, :], bound[:, None], best[:, None]))
    sums = sums[row, entry]
    for low, high in zip(ends, ends[1:]):
        sums = sums + scaled(row, entry, low, high)
        left = _may_win(sums, entry, bound[row], best[row])
        row, entry, sums = row[left], entry[left], sums[left]
    # What is left is better than the leader; the last of a row in this order is its best.
    order = np.lexsort((entry, sums, row))[::-1]
    best[row[order]], bound[row[order]] = entry[order], sums[order]
    return best, bound // size


def _may_win(sums: np.ndarray, entry: np.ndarray, bound: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Whether an entry with these sums so far may still be nearer than the best one, or as near and before it."""
    return (sums < bound) | ((sums == bound) & (entry < best))


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers, as machine words where all products fit them, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = values.astype(np.float64) * scale  # exact: a power of two
    width = max(1, values.shape[-1])
    # A sum of squared differences of transformed parts is at most 4 width^3 times the largest square.
    if not scaled.size or np.abs(scaled).max() < 2.0**30 / max(1.0, float(1 << (width - 1).bit_length()) ** 1.5):
        return np.floor(scaled).astype(np.int64)
    exact = [_floor(float(v), scale) for v in values.reshape(-1)]
    return np.array(exact, dtype=object).reshape(values.shape)


def _floor(value: float, scale: int) -> int:
    over, under = value.as_integer_ratio()
    return scale * over // under


def usable(vectors: pa.Array) -> np.ndarray:
    """Which rows hold a vector of finite numbers only."""
    flat = vectors.flatten()
    bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(bad)])[np.concatenate([[0], np.cumsum(sizes)])]
    return ~vectors.is_null().to_numpy(zero_copy_only=False) & (np.diff(ends) == 0)


def _cut(vectors: pa.Array, width: int) -> np.ndarray:
    """Integers of usable vectors by part: rows, parts, components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return whole_numbers(flat.reshape(len(vectors), PARTS, width))


def finite(df: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector isn't null and has finite components only."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & (x.cast("double") != nan) & (F.abs(x.cast("double")) != inf)
    return df.filter(F.col(f"`{vector_col}`").isNotNull() & F.forall(f"`{vector_col}`", fine))


def _first_books(df: DataFrame, id_col: str, vector_col: str) -> tuple[list[list[list[int]]], int]:
    """Entries by part of the vectors with the least ids, and a part's width."""
    kept = finite(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")), "v")
    seen = kept.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if seen["low"] != seen["high"]:
        raise ValueError(f"{vector_col} has vectors of {seen['low']} to {seen['high']} components; a codebook needs one length")
    if (seen["low"] or 0) % PARTS:
        raise ValueError(f"vectors of {seen['low']} components can't be cut into {PARTS} equal parts")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    width = (seen["low"] or 0) // PARTS
    seeds = whole_numbers(np.array([r["v"] for r in first], dtype=np.float64).reshape(len(first), PARTS, width))
    return [[[int(x) for x in vector[p]] for vector in seeds] for p in range(PARTS)], width


def _as_array(books: list, parts: np.ndarray) -> np.ndarray:
    """Codebooks in the kind of integers that fits them and the parts they are compared with."""
    top = max((abs(x) for book in books for entry in book for x in entry), default=0)
    size = float(1 << (max(1, parts.shape[-1]) - 1).bit_length())
    small = parts.dtype != object and top < 2.0**30 / size**1.5
    return np.array(books, dtype=np.int64 if small else object).reshape(PARTS, len(books[0]), parts.shape[-1])


def _assigned(parts: np.ndarray, books: list) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance of every part: rows by parts."""
    entries = _as_array(books, parts)
    if entries.dtype == object:
        parts = parts.astype(object)
    codes, errors = np.empty((len(parts), PARTS), dtype=np.int64), np.empty((len(parts), PARTS), dtype=parts.dtype)
    for p in range(PARTS):
        codes[:, p], errors[:, p] = nearest(parts[:, p], entries[p])
    return codes, errors


def _moved(vectors: DataFrame, books: list, width: int) -> list:
    """Every entry as the floored mean of the parts assigned to it; an entry without parts stays.

    Tasks add up what they read; a row for each part, entry and task is shuffled, and the
    driver gets one of each part and entry.
    """
    n = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[[0] * width for _ in range(n)] for _ in range(PARTS)]
        counts = np.zeros((PARTS, n), dtype=np.int64)
        for parts in _part_blocks(batches, width):
            codes, _ = _assigned(parts, books)
            for p in range(PARTS):
                counts[p] += np.bincount(codes[:, p], minlength=n)
                for e in np.unique(codes[:, p]).tolist():
                    added = parts[codes[:, p] == e, p].sum(axis=0)
                    sums[p][e] = [a + int(b) for a, b in zip(sums[p][e], added)]
        used = [(p, e) for p in range(PARTS) for e in range(n) if counts[p, e]]
        if used:
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([u[k] for u in used], pa.int32()) for k in (0, 1)],
                    pa.array([int(counts[u]) for u in used], pa.int64()),
                    pa.array([[str(x) for x in sums[p][e]] for p, e in used], pa.list_(pa.string())),
                ],
                names=["part", "entry", "n", "sums"],
            )

    found = vectors.mapInArrow(run, "part int, entry int, n long, sums array<string>")
    each = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
    added = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = [[list(entry) for entry in book] for book in books]
    for r in added.collect():  # one row for each component of the codebooks
        out[r["part"]][r["entry"]][r["at"]] = int(r["value"]) // r["n"]
    return out


def _part_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        vectors = batch.column(batch.num_columns - 1)
        vectors = vectors.filter(pa.array(usable(vectors)))
        for low in range(0, len(vectors), ROWS):
            yield _cut(vectors.slice(low, ROWS), width)


def learn(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks by part, entry and component from all vectors of ``df``; see ``compress``."""
    books, width = _first_books(df, id_col, vector_col)
    vectors = df.select(F.col(f"`{vector_col}`"))
    if books[0]:
        for _ in range(rounds):
            books = _moved(vectors, books, width)
    return books


def encode(df: DataFrame, books: list[list[list[int]]], vector_col: str = "embedding") -> DataFrame:
    """``df`` without unusable vectors, with ``code`` and ``error`` in place of the vector; such columns are replaced."""
    kept = [c for c in df.columns if c not in (vector_col, "code", "error")]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    width = len(books[0][0]) if books[0] else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(usable(whole.column(len(kept)))))
            codes, errors = [], []
            for parts in _part_blocks(iter([batch]), width):
                found, distances = _assigned(parts, books)
                codes += [bytes(row).hex() for row in found.astype(np.uint8)]
                errors += [int(x) for x in distances.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{vector_col}`")).mapInArrow(run, schema)


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Id, label, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every usable vector.

    A component x becomes floor(``SCALE`` x); a vector is cut into ``PARTS`` parts.  The
    codebook of each part starts as that part of the ``ENTRIES`` vectors of the least ids;
    each round assigns all parts to their nearest entries (equal distances: the lower
    index) and makes every entry the floored mean of its parts; entries without parts
    stay.  ``error`` sums the squared distances to the last entries, ``label_error`` the
    errors of a label.

    A null vector and one with a null or non-finite component is dropped.  Null ids come
    after all others; rows of one id are taken by their vectors, each as often as it is
    there, so that repeated rows count.  Null labels are one label.  Of fewer vectors
    than entries the codebooks have as many entries.  Vectors of several lengths, or of
    one that can't be cut into equal parts, are an error.  Numbers too large for machine
    words are worked out in Python's; an error beyond a long is an error.  An empty table
    gives no rows, an empty vector has empty parts and error 0.

    The table is read once a round; tasks add up their parts, so that the codebooks alone
    (``ENTRIES`` vectors) pass the driver.  Errors are added up by label before they are
    joined back; AQE splits a hot label.
    """
    books = learn(df, id_col, vector_col, rounds)
    named = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").alias("__label"), F.col(f"`{vector_col}`").alias("__vector"))
    coded = encode(named, books, "__vector")
    sums = coded.groupBy("__label").agg(F.sum("error").alias("label_error"))
    label = free_name(coded, label_col)
    return join_same(coded, sums, ["__label"]).select(
        F.col("__id").alias(id_col), F.col("__label").alias(label), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
