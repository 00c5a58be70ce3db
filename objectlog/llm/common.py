"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, release, shared_folder

BATCH_BYTES = "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package: as the library's, and Arrow batches bounded in bytes, not only in rows."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` to the cluster's shared folder and read it back: cuts the lineage, survives lost executors."""
    return stored_at(df, name, codec)[0]


def stored_at(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """As `stored`, with the path, for tables that go before the job ends (see `session.remove`)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` without input columns whose names (in any case) an operator's own result columns take."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def same(df: DataFrame) -> list[Column]:
    """All columns of `df` by their exact names."""
    return [col(c) for c in df.columns]


def utf8(name: str) -> Column:
    """The UTF-8 bytes of a text column; null stays null."""
    return F.col(name).cast("binary")


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
