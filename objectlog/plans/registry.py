"""Queries by name, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import quoted
from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so both engines agree on them."""
    return df.select(
        *[
            F.round(quoted(f.name), DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(configure(spark), folder))

        if name in QUERIES:
            raise ValueError(f"Query {name!r} is registered twice.")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register
