"""Logs on storage: one parquet table each, the big ones by day."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import E2O, EVENT, ObjectLog, TableMeta
from .normalize import normalize

_BY_DAY = (EVENT, E2O)
_META = "meta"
SPLITS = ("train", "val", "test")


def save(log: ObjectLog, path: str, *, typed_links: bool = False, normalized: bool = True) -> None:
    """Write every table; `event` and `e2o` by day, balanced whatever the day's size.

    Column types are settled here (unless not `normalized`), so that loading has
    nothing to look up in the rows.

    `typed_links` adds the joined link table by object type, which label jobs then
    read without any join.
    """
    if normalized:
        log = normalize(log)
    if typed_links:
        log = log.with_typed_links()
    spark = log.event.sparkSession
    for name, df in log.tables.items():
        target = f"{path}/{name}"
        if name in _BY_DAY:
            dated = df.withColumn("day", F.to_date("time")).hint("rebalance", "day")
            dated.sortWithinPartitions("day", "time").write.mode("overwrite").partitionBy("day").parquet(target)
        elif name == "typed_link":
            df.hint("rebalance", "object_type").write.mode("overwrite").partitionBy("object_type").parquet(target)
        else:
            df.write.mode("overwrite").parquet(target)
    tables = {n: {"pk": m.pk, "fks": dict(m.fks), "time_col": m.time_col} for n, m in log.meta.items()}
    meta = {"normalized": normalized, "tables": tables}
    spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{_META}")


def load(
    spark: SparkSession,
    path: str,
    *,
    since: date | None = None,
    until: date | None = None,
    normalized: bool = True,
) -> ObjectLog:
    """Read a stored log; days outside [since, until] of `event` and `e2o` are not read.

    No job looks at the rows, but where the log was stored without settled types and `normalized` asks for them.
    """
    stored = json.loads(spark.read.text(f"{path}/{_META}").first()[0])
    meta = {n: TableMeta(**m) for n, m in stored["tables"].items()}
    tables = {}
    for name in meta:
        df = spark.read.parquet(f"{path}/{name}")
        if name in _BY_DAY:
            if since is not None:
                df = df.where(F.col("day") >= F.lit(since))
            if until is not None:
                df = df.where(F.col("day") <= F.lit(until))
            df = df.drop("day")
        tables[name] = df
    log = ObjectLog(tables, meta)
    return normalize(log) if normalized and not stored["normalized"] else log


def save_labels(splits: Mapping[str, DataFrame], path: str, job: str) -> None:
    """Write the label tables of a job, a folder for each split; what was stored for the job before is replaced."""
    for split, df in splits.items():
        df.write.mode("overwrite").parquet(f"{path}/{job}/{split}")


def load_labels(spark: SparkSession, path: str, job: str, splits: Sequence[str] = SPLITS) -> dict[str, DataFrame]:
    """The stored label tables of a job by split; runs no job on their rows."""
    return {split: spark.read.parquet(f"{path}/{job}/{split}") for split in splits}
