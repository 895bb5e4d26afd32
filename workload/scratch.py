"""Folders for what a query writes: in the shared checkpoint folder, new each time."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from chartloom import checkpoint_folder


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/chartloom/{name}-{uuid.uuid4().hex}"
