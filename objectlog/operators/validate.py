"""Structural checks of a log, as data: one row per rule and column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import E2O, EVENT, O2O, OBJECT, ObjectLog, quoted

REQUIRED_TABLES = (EVENT, OBJECT, E2O)
REQUIRED_COLUMNS = {
    EVENT: ("event_id", "type", "time"),
    OBJECT: ("object_id", "type", "time"),
    E2O: ("event_id", "object_id"),
    O2O: ("object_id_src", "object_id_dst"),
}
NON_NULL_COLUMNS = {
    EVENT: ("event_id", "type"),
    OBJECT: ("object_id", "type"),
    E2O: ("event_id", "object_id", "qualifier"),
    O2O: ("object_id_src", "object_id_dst"),
}
REFERENCES = (
    (E2O, "event_id", EVENT, "event_id"),
    (E2O, "object_id", OBJECT, "object_id"),
    (O2O, "object_id_src", OBJECT, "object_id"),
    (O2O, "object_id_dst", OBJECT, "object_id"),
)
PREVIEW = 5


class InvalidLog(ValueError):
    pass


def require_columns(log: ObjectLog) -> None:
    """Schema check; runs no job."""
    missing = [name for name in REQUIRED_TABLES if name not in log]
    if missing:
        raise InvalidLog(f"missing required table(s): {', '.join(missing)}")
    for name, columns in REQUIRED_COLUMNS.items():
        if name in log:
            absent = [c for c in columns if c not in log[name].columns]
            if absent:
                raise InvalidLog(f"table {name!r} lacks column(s): {', '.join(absent)}")


def null_counts(log: ObjectLog) -> DataFrame:
    """Nulls per required column, one pass per table."""
    parts = []
    for name, columns in NON_NULL_COLUMNS.items():
        if name not in log:
            continue
        present = [c for c in columns if c in log[name].columns]
        counts = log[name].agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in present])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_bad")) for c in present])
        parts.append(counts.select(F.lit(name).alias("table"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(log: ObjectLog, name: str) -> DataFrame:
    """Primary-key values used more than once, with their number of rows."""
    key = log.meta[name].pk
    return log[name].groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def dangling(log: ObjectLog, table: str, column: str, target: str, target_column: str) -> DataFrame:
    """Distinct ids without a partner in the target table."""
    ids = log[table].select(F.col(column).alias("id")).where(F.col("id").isNotNull()).distinct()
    return ids.join(log[target].select(F.col(target_column).alias("id")), "id", "left_anti")


def _found(bad: DataFrame, key: str, rule: str, table: str, column: str) -> DataFrame:
    count = bad.agg(F.count(F.lit(1)).alias("n_bad"))
    preview = bad.select(F.col(key).cast("string").alias("id")).orderBy("id").limit(PREVIEW)
    sample = preview.agg(F.sort_array(F.collect_list("id")).alias("sample")).scalar()
    return count.select(
        F.lit(rule).alias("rule"),
        F.lit(table).alias("table"),
        F.lit(column).alias("column"),
        "n_bad",
        sample.alias("sample"),
    )


def validate(log: ObjectLog) -> DataFrame:
    """rule, table, column, n_bad, sample for every check; `n_bad` 0 means passed."""
    require_columns(log)
    nothing = F.array().cast("array<string>").alias("sample")
    parts = [null_counts(log).select(F.lit("non_null").alias("rule"), "table", "column", "n_bad", nothing)]
    for name in (EVENT, OBJECT):
        key = log.meta[name].pk
        parts.append(_found(duplicate_keys(log, name), key, "unique", name, key))
    for table, column, target, target_column in REFERENCES:
        if table in log:
            bad = dangling(log, table, column, target, target_column)
            parts.append(_found(bad, "id", "reference", table, column))
    return reduce(DataFrame.unionByName, parts)


def checked(log: ObjectLog) -> ObjectLog:
    """The same log, or an error naming every broken rule."""
    broken = validate(log).where("n_bad > 0").collect()
    if broken:
        raise InvalidLog(
            "; ".join(f"{r.rule} {r.table}.{r.column}: {r.n_bad} {list(r.sample)}" for r in broken)
        )
    return log
