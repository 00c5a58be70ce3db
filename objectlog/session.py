"""Session settings the operators rely on, and reliable lineage cuts."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime SQL settings. The UTC zone makes zone-free timestamps plain numbers. A
# skewed join is split even where that costs one more exchange: without the last
# setting Spark keeps a hot key in one task whenever the next aggregation could
# reuse the join's partitioning.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# The most that a task reads of files and, as long as there are partitions enough, of a shuffle. Its hash tables and
# sorts are several times that, so with Spark's own 128 and 64 MB they grow with the input for long. A session's smaller
# values stay.
_MOST = {
    "spark.sql.files.maxPartitionBytes": 32 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
}


def _size(text: str) -> int | None:
    """Bytes of a size as Spark's settings write it (`64MB`, `8m`, `134217728b`)."""
    found = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", text.lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else None


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    for key, most in _MOST.items():
        now = _size(spark.conf.get(key))
        if now is not None and now > most:
            spark.conf.set(key, f"{most}b")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors reach, for checkpoints and written tables.

    It lies in the one named by `spark.checkpoint.dir`. A scratch folder is used
    only in local mode, where the session names none (tests, laptops); on a cluster
    a folder must be named, as other machines do not see a local one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("Name a shared folder in spark.checkpoint.dir.")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder; survives executor loss.

    As a Parquet table: one job, packed columns. A checkpoint takes two jobs (it computes its last stage again) and writes
    whole rows as they lie in memory; it remains for the few schemas that Parquet cannot hold.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    names = {c.lower() for c in df.columns}
    if len(names) < len(df.columns) or not names or re.search(r"\b(void|interval)\b|struct<>", df.schema.simpleString()):
        return df.checkpoint(eager=True)
    path = f"{folder}/cut-{uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs.

    It does so once the driver's collector has found their plans unused, which by itself may be half an hour later; a
    job of many steps would hold the shuffles of all its steps on disk till then.
    """
    spark._jvm.System.gc()


def written(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict, str]:
    """`df` written to the shared folder and read back, aggregates measured by the write itself, and the path.

    One job, where a checkpoint takes two (it computes its last stage again) and a measure a third.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in measures.items()]).write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path), seen.get, path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of `written` that no plan reads any more, on whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
