"""Service calls under way at a time, their limits, and what happens when the service is down."""

from __future__ import annotations

import os
import sys
import threading
import time

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chartloom.operators import enrich

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answers(df):
    return [(r["id"], r["size"], r["error"]) for r in df.collect()]


def test_calls_overlap_and_keep_their_order(spark):
    def client():
        lock, under_way = threading.Lock(), [0]

        def call(batch):
            with lock:
                under_way[0] += 1
                seen = under_way[0]
            time.sleep(0.02 if batch["id"].iloc[0] % 20 else 0.1)
            with lock:
                under_way[0] -= 1
            return pd.DataFrame({"size": batch["id"] * 2, "seen": seen})

        return call

    df = spark.range(0, 200, 1, 1).select("id")
    for most in (1, 6):
        got = enrich(df, client, ["id"], "size long, seen int", batch_size=5, in_flight=most).collect()
        assert [(r["id"], r["size"], r["error"]) for r in got] == [(i, 2 * i, None) for i in range(200)]
        assert max(r["seen"] for r in got) == most


def test_rate_is_kept(spark):
    def client():
        return lambda batch: pd.DataFrame({"size": [time.time()] * len(batch)})

    got = answers(enrich(spark.range(0, 12, 1, 1), client, ["id"], "size double", batch_size=1, in_flight=6, per_second=10))
    times = sorted(t for _, t, _ in got)
    assert times[-1] - times[0] > 1.0


def test_breaker(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def client():
        def call(batch):
            with open(calls, "a") as out:
                out.write("x\n")
            if batch["id"].iloc[0] >= 10 and os.path.getsize(calls) < 50:
                raise ConnectionError("down")
            return pd.DataFrame({"size": batch["id"]})

        return call

    df = spark.range(0, 40, 1, 1)
    got = answers(enrich(df, client, ["id"], "size long", batch_size=1, retries=0, breaker=4, pause=60))
    assert got[:10] == [(i, i, None) for i in range(10)]
    assert [e for _, _, e in got[10:14]] == ["ConnectionError: down"] * 4
    assert {e for _, _, e in got[14:]} == {"not called: 4 calls in a row had failed"}
    os.remove(calls)
    # Without a pause each call decides anew.
    got = answers(enrich(df, client, ["id"], "size long", batch_size=1, retries=0, breaker=4, pause=0))
    assert got[-1] == (39, 39, None) and sum(e is not None for _, _, e in got) < 30 and not any("not called" in (e or "") for _, _, e in got)


def test_retries_send_the_same_key(spark, tmp_path):
    folder = str(tmp_path)

    def client():
        def call(batch):
            for k in batch["key"]:
                with open(f"{folder}/{k}", "a") as out:
                    out.write("x")
            if len(batch) > 1 or any(os.path.getsize(f"{folder}/{k}") < 3 for k in batch["key"]):
                raise ConnectionError("again")
            return pd.DataFrame({"size": batch["id"]})

        return call

    df = spark.range(0, 6, 1, 1).union(spark.range(0, 1, 1, 1)).select("id", F.lit(None).cast("string").alias("none"))
    got = answers(enrich(df, client, ["id", "none"], "size long", batch_size=2, retries=1, backoff=0.01, request_key="key"))
    assert sorted(got) == sorted([(i, i, None) for i in [*range(6), 0]])
    assert len(os.listdir(folder)) == 6
