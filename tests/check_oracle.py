"""Run registered queries and their SQL side by side and compare the rows.

    python tests/check_oracle.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when rows and column names agree, else what differs."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    expected = Counter(tuple(plain(row[names.index(n)]) for n in order) for row in cursor.fetchall())
    columns = df.columns
    actual = Counter(tuple(plain(row[columns.index(n)]) for n in order) for row in df.collect())
    if expected == actual:
        return None
    extra, lacking = actual - expected, expected - actual
    show = lambda c: str(list(c)[:2])[:700]
    return (
        f"{sum(actual.values())} rows against {sum(expected.values())}; columns {order}; "
        f"{sum(extra.values())} only Spark: {show(extra)}; {sum(lacking.values())} only SQL: {show(lacking)}"
    )


def main() -> int:
    import __spark_entry__ as entry
    from chartloom import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = database(sf_dir), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if args and not any(a in name for a in args):
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                count = con.execute(f"SELECT count(*) FROM ({oracle[name]})").fetchone()[0]
            else:
                problem, count = None, df.count()
        except Exception as exc:  # report and go on with the next query
            problem, count = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        print(f"{'ok  ' if problem is None else 'BAD '} {name:36} {count:8} rows {time.time() - began:6.2f}s"
              f"{'' if name in oracle else '  (no SQL)'}", flush=True)
        if problem:
            print("     ", problem, flush=True)
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
