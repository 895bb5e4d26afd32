"""The contract of a custom step, and a chain of steps with one failure table.

A step declares its parameters with defaults and allowed values, gets one
``prepare`` call per run (lookups, clients), and turns a frame into a good and a
failed frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators.records import union_all
from chartloom.session import checkpoint_folder
from chartloom.sources.sinks import failure_rows


@dataclass(frozen=True)
class Param:
    """One parameter: default, allowed values, description."""

    default: Any = None
    allowed: Sequence[Any] | None = None
    required: bool = False
    doc: str = ""

    def check(self, name: str, value: Any) -> Any:
        """The value in the type of the default; raises ``ValueError`` if not allowed."""
        value = _as_type_of(self.default, value, name)
        if self.required and value in (None, ""):
            raise ValueError(f"parameter {name!r} is required")
        if self.allowed is not None and value not in self.allowed:
            raise ValueError(f"parameter {name!r} must be one of {list(self.allowed)}, not {value!r}")
        return value


def _as_type_of(default: Any, value: Any, name: str) -> Any:
    """Text from a config file in the type of the default."""
    if not isinstance(value, str) or default is None or isinstance(default, str):
        return value
    if isinstance(default, bool):
        if value.lower() not in ("true", "false"):
            raise ValueError(f"parameter {name!r} must be true or false, not {value!r}")
        return value.lower() == "true"
    if isinstance(default, (int, float)):
        return type(default)(value)
    return value


class Transform:
    """Base of a step: subclass, declare ``params``, write ``apply``."""

    params: ClassVar[dict[str, Param]] = {}

    def __init__(self, **values: Any) -> None:
        unknown = set(values) - set(self.params)
        if unknown:
            raise ValueError(f"{type(self).__name__} has no parameter {sorted(unknown)}")
        for name, param in self.params.items():
            setattr(self, name, param.check(name, values.get(name, param.default)))

    def prepare(self, spark: SparkSession) -> None:
        """One-time work before a run."""

    def apply(self, df: DataFrame) -> DataFrame | tuple[DataFrame, DataFrame | None]:
        """(good rows, failed rows with ``error``, or None when nothing can fail).

        A costly step returns one frame instead, in which ``error`` marks the failed.
        """
        raise NotImplementedError


@dataclass
class FlowResult:
    """Good rows and failures (``step, error, record``) of a chain."""

    good: DataFrame
    failures: DataFrame | None


@dataclass
class Flow:
    """Steps one after another; a row that fails a step leaves the chain there.

    With ``cut``, the result of a step that marks its failures is checkpointed before
    it is taken apart, so that it is computed once and survives lost executors.
    """

    steps: Sequence[Transform] = field(default_factory=list)
    cut: bool = False

    def run(self, df: DataFrame) -> FlowResult:
        spark, failures = df.sparkSession, []
        for step in self.steps:
            step.prepare(spark)
            result = step.apply(df)
            if isinstance(result, DataFrame):
                if self.cut:
                    checkpoint_folder(spark)
                    result = result.checkpoint()
                result = split_failed(result)
            df, failed = result
            if failed is not None:
                failures.append(failure_rows(failed, type(step).__name__))
        return FlowResult(df, union_all(failures) if failures else None)


def split_failed(df: DataFrame, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Take a frame with an ``error`` column apart: (good, failed without ``drop``)."""
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull()).drop(*drop)
