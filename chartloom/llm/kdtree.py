"""Shards as leaves of a k-d tree over the rows' metadata, cut at weighted medians."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chartloom.llm.common import cut

#: A cut is found digit by digit: a pass counts the weight by one digit of 16 bits.
DIGIT = 16
#: Rows of a shard that are numbered together; a shard has as many such parts as it needs.
SLOT_ROWS = 200_000


#: A cut may be off by this part of its cell's weight.
FINE = 4096
#: Beyond all coordinates, which are scaled to 32 bits.
END = 2**33


@dataclass
class Cell:
    """A part of the data that gets ``shards`` shards, the first of which is ``first``."""

    first: int
    shards: int


@dataclass
class _Plan:
    """Where a cell is to be cut: ``goal`` is the weight before the cut, ``rest`` what is still undecided."""

    cell: int
    dim: int
    goal: int
    weight: int
    rest: int = -1
    digits: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rest = self.weight

    def cut(self) -> tuple[int, int, int, int, int]:
        d = [*self.digits, 0, 0, 0, 0, 0, 0]
        return (self.cell, self.dim, *[d[i] << DIGIT | d[i + 1] for i in (0, 2, 4)])


def coordinate(df: DataFrame, name: str) -> Column:
    """A long that orders a column's values as they are ordered; null counts as -1.

    Text counts by its first six bytes; numbers and times by their value.
    """
    kind, col = df.schema[name].dataType, df[name]
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, 6)), 12, "0")
        value = F.conv(head, 16, 10).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = F.unix_micros(col.cast("timestamp"))
    elif isinstance(kind, T.IntegralType):
        value = col.cast("long")
    else:
        value = F.round(col.cast("double") * 1000).cast("long")
    return F.coalesce(value, F.lit(-1))


def assign(points: DataFrame, n_dims: int, n_shards: int) -> DataFrame:
    """``points`` (coords, tie, weight) with a column ``shard``.

    A cell is cut along the dimension that is widest in it, at the key where the
    weight before the cut reaches its shards' part of the cell's.  Only one row per
    cell comes to the driver, and cells travel back as a broadcast table of at most
    ``n_shards`` rows.  Rows with equal coordinates are told apart by ``tie``, so
    that one value that holds a third of all rows is cut like any other.
    """
    spark = points.sparkSession
    cells, levels = {0: Cell(0, n_shards)}, []
    while any(c.shards > 1 for c in cells.values()):
        placed = _placed(spark, points, levels)
        seen = {r["cell"]: r for r in placed.groupBy("cell").agg(*_ranges(n_dims), F.sum("weight").alias("weight")).collect()}
        plans, grown, cuts = [], {}, []
        for key, cell in cells.items():
            if cell.shards == 1 or key not in seen:
                grown[2 * key] = cell
                cuts.append((key, 0, END, 0, 0))  # all rows stay on the left
                continue
            row, left = seen[key], cell.shards // 2
            dim = max(range(n_dims), key=lambda d: (row[f"hi{d}"] - row[f"lo{d}"], -d))  # noqa: B023
            plans.append(_Plan(key, dim, row["weight"] * left // cell.shards, row["weight"]))
            grown[2 * key], grown[2 * key + 1] = Cell(cell.first, left), Cell(cell.first + left, cell.shards - left)
        if not plans:
            break
        _find_cuts(spark, placed, plans)
        levels.append(cuts + [p.cut() for p in plans])
        cells = grown
    first = _rows(spark, [(k, c.first) for k, c in cells.items()], ["cell long", "shard int"])
    return _placed(spark, points, levels).join(F.broadcast(first), "cell").drop("cell")


def _ranges(n_dims: int) -> list[Column]:
    coord = lambda d: F.get(F.col("coords"), F.lit(d))
    return [f(coord(d)).alias(f"{n}{d}") for d in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]


def _rows(spark: SparkSession, rows: list[tuple], fields: list[str]) -> DataFrame:
    """A few rows of numbers as literals: unlike ``createDataFrame`` it takes no Python on executors."""
    made = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, map(str.split, fields), strict=True)]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*made)))


def _key() -> list[Column]:
    """What rows of a cell are ordered by: the coordinate in the cell's dimension, then the ties."""
    return [F.get("coords", "dim"), F.get("tie", F.lit(0)), F.get("tie", F.lit(1))]


def _placed(spark: SparkSession, points: DataFrame, levels: list[list[tuple]]) -> DataFrame:
    """The cell of each row, by one broadcast table of cuts for each level."""
    out = points.withColumn("cell", F.lit(0).cast("long"))
    for cuts in levels:
        table = _rows(spark, cuts, ["cell long", "dim int", "a long", "b long", "c long"])
        mine = F.struct(*[k.alias(n) for k, n in zip(_key(), "abc", strict=True)])
        right = (mine >= F.struct("a", "b", "c")).cast("long")
        out = out.join(F.broadcast(table), "cell").withColumn("cell", F.col("cell") * 2 + right).drop("dim", "a", "b", "c")
    return out


def _find_cuts(spark: SparkSession, placed: DataFrame, plans: list[_Plan]) -> None:
    """Fill in the digits of each plan's cut, one counting pass for a digit of all cells.

    Passes end when what may lie on the wrong side is at most 1 / ``FINE`` of each
    cell; six digits tell all keys apart.
    """
    digit = lambda i: F.shiftright(_key()[i // 2], DIGIT * (1 - i % 2)).bitwiseAND(F.lit(2**DIGIT - 1).cast("long"))
    for n in range(6):
        waiting = [p for p in plans if p.rest * FINE > p.weight]
        if not waiting:
            break
        rows = [(p.cell, p.dim, p.goal, *p.digits) for p in waiting]
        table = _rows(spark, rows, ["cell long", "dim int", "goal long", *[f"d{i} long" for i in range(n)]])
        joined = placed.join(F.broadcast(table), "cell")
        for i in range(n):
            joined = joined.filter(digit(i) == F.col(f"d{i}"))
        counted = joined.groupBy("cell", "goal", digit(n).alias("digit")).agg(F.sum("weight").alias("w"))
        order = Window.partitionBy("cell").orderBy("digit")  # at most 65,536 rows of a cell
        upto = counted.withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        hit = upto.filter("upto > goal").groupBy("cell").agg(F.min(F.struct("digit", "upto", "w")).alias("m"))
        found = {r["cell"]: r["m"] for r in hit.collect()}
        for p in waiting:
            m = found[p.cell]
            p.goal, p.rest, p.digits = p.goal - (m["upto"] - m["w"]), m["w"], [*p.digits, m["digit"]]


def kd_shards(
    df: DataFrame,
    dims: Sequence[str],
    size: Column,
    n_shards: int | None = None,
    target_bytes: int | None = None,
    tie: Column | None = None,
    keep: Sequence[Column | str] = (),
) -> DataFrame:
    """``keep`` columns, ``size``, ``shard`` and ``slot`` (0, 1, ... in each shard) of every row.

    ``n_shards``, or as many as ``target_bytes`` asks for, near equal in size.
    ``tie`` (a long of 32 bits) orders rows with equal metadata; rows that are
    equal in it too are told apart by their number.  The rows' metadata are written
    to the checkpoint folder once; texts are read once and never moved.  A null
    counts as -1 in its dimension; an empty table gives no rows.
    Repeated rows each get a slot of their own.
    """
    wide = F.array(*[coordinate(df, c) for c in dims])
    low32 = F.lit(2**32 - 1).cast("long")
    points = df.select(
        *keep,
        size.cast("long").alias("size"),
        wide.alias("coords"),
        (tie if tie is not None else F.lit(0)).cast("long").bitwiseAND(low32).alias("tie1"),
        F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(low32).alias("tie2"),
    )
    points = cut(points)  # the rows' numbers must stay as they are
    names = [c for c in points.columns if c not in ("coords", "tie1", "tie2")]
    whole = points.agg(*_ranges(len(dims))).first()
    scaled = [
        F.floor((F.get("coords", F.lit(d)).cast("double") - whole[f"lo{d}"]) / max(1, whole[f"hi{d}"] - whole[f"lo{d}"]) * (2**32 - 1))
        if whole[f"lo{d}"] is not None
        else F.lit(0)
        for d in range(len(dims))
    ]
    points = points.select(
        *names, F.array(*[c.cast("long") for c in scaled]).alias("coords"), F.array("tie1", "tie2").alias("tie"), F.col("size").alias("weight")
    )
    if n_shards is None:
        total = points.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, -(-total // target_bytes))
    placed = assign(points, len(dims), n_shards)
    n_rows = points.count()
    parts = max(16, n_rows // (n_shards * SLOT_ROWS))
    placed = placed.withColumn("part", F.pmod(F.get("tie", F.lit(1)), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy(F.get("tie", F.lit(1)), F.get("tie", F.lit(0)), "size")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "part"]).select(*names, "shard", (F.col("offset") + F.col("at")).alias("slot"))
