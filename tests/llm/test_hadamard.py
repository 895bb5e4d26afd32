from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from chartloom.llm import hadamard


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract in Python's integers, all distances worked out."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign(p):
        return [min((far(c[p], e), k) for k, e in enumerate(books[p])) for c in cut]

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c, (_, k) in zip(cut, assign(p)):
                held[k].append(c[p])
            for k, members in held.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    found = [assign(p) for p in range(parts)]
    errors = [sum(found[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{found[p][n][1]:02x}" for p in range(parts)), errors[n], by_label[label], sha) for n, (i, _, label) in enumerate(kept)), key=str
    )


def ours(df, **options):
    found = hadamard.compress(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in found.collect()), key=str)


def as_float32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def test_edge_rows(spark):
    rng = random.Random(2)
    rows = [(i, as_float32([rng.gauss(0, 0.2) for _ in range(24)]), rng.choice([0, 0, 1, None])) for i in range(120)]
    rows += [(3, rows[3][1], 0), (3, rows[4][1], 1), (None, rows[5][1], None), (500, None, 1), (501, [math.nan] * 24, 1), (502, [None] * 24, 2)]
    rows += [(503, [math.inf] + [0.0] * 23, 2), (504, [-math.inf] * 24, 2), (-1, [0.0] * 24, 3), (-2, [-0.0] * 24, 3), (505, [0.5] * 23 + [None], 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, code int, error string")
    assert ours(df) == brute(rows)
    assert ours(df.limit(0)) == []
    few = rows[:5]
    assert ours(spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")) == brute(few)
    assert ours(spark.createDataFrame([(1, [], 1), (2, None, 1)], "vec_id long, embedding array<float>, label int")) == brute([(1, [], 1)])


def test_ties_and_large_numbers(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(8)], None) for i in range(60)]
    rows += [(i, [rng.choice([1e5, -3e5, 0.1, 2.0**18]) for _ in range(8)], i % 2) for i in range(60, 100)]
    schema = "vec_id long, embedding array<double>, label int"
    assert ours(spark.createDataFrame(rows, schema)) == brute(rows)


def test_lengths_that_do_not_fit(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)]):
        with pytest.raises(ValueError, match="components"):
            hadamard.compress(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize("width", [1, 2, 3, 8, 13])
def test_nearest_against_all_distances(width):
    rng = np.random.default_rng(width)
    parts, entries = rng.integers(-5, 6, (400, width)), rng.integers(-5, 6, (16, width))
    far = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    for kind in (np.int64, object):
        codes, errors = hadamard.nearest(parts.astype(kind), entries.astype(kind))
        assert codes.tolist() == far.argmin(axis=1).tolist() and [int(x) for x in errors] == far.min(axis=1).tolist()


def test_sequency_order():
    for size in (1, 2, 4, 8, 32):
        rows = hadamard.transform(np.eye(size, dtype=np.int64)).T
        assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(size))
        assert (rows @ rows.T == size * np.eye(size)).all()
