"""Registered queries: operators run on the test tables, each with its SQL twin.

The tables are no clinical data.  ``workload.inputs`` shapes them into the records
the operators expect, by expressions that the SQL twins repeat.
"""

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def load_all() -> None:
    from workload import (  # noqa: F401
        assembly,
        casting,
        cohort,
        enrichment,
        files,
        joins,
        json_files,
        ledgers,
        mapping,
        open_records,
        requests,
        responses,
        stores,
        streams,
    )
