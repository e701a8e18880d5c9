"""The query registry and small helpers for comparable output."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.scale import checkpoint_dir

HOUR = 3_600_000_000
DAY = 24 * HOUR


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return add


# Added before rounding: means of whole microseconds often end in an exact 5, which the two
# engines round differently.
NUDGE = 3.7e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed scale, so that summation order does not show; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`") + F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def rd(expr: str, name: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {name}"
