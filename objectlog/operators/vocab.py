"""Counts, type vocabularies, object durations, column roles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import timedelta
from fnmatch import fnmatch
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import seconds_between
from ..functions.ordered import lagged
from ..model import ObjectLog, as_list, quoted

_TABLES = {"event": ("event", "event_id"), "object": ("object", "object_id")}


def entity_count(log: ObjectLog, entity: str, *, approx: bool = False) -> DataFrame:
    table, key = _TABLES[entity]
    n = F.approx_count_distinct(key) if approx else F.count_distinct(key)
    return log[table].agg(n.alias(f"num_{entity}s"))


def types(log: ObjectLog, entity: str, linked_to: str | Iterable[str] | None = None) -> DataFrame:
    """Distinct types, or only those linked to the given types of the other side."""
    table, _ = _TABLES[entity]
    named = F.col("type").cast("string").alias("type")
    if linked_to is None:
        return log[table].select(named).where("type IS NOT NULL").distinct()
    wanted = sorted(set(as_list(linked_to)))
    if not wanted:
        return log[table].select(named).limit(0)
    if entity == "object":
        seen = log.links(wanted).select("object_id").distinct()
        return log.object.join(seen, "object_id", "left_semi").select(named).where(
            "type IS NOT NULL"
        ).distinct()
    # Collapse links to (object, event type) before the join with the objects.
    pairs = log.links().select("object_id", "type").distinct()
    return pairs.join(log.objects_of(wanted).select("object_id"), "object_id", "left_semi").select(
        named
    ).where("type IS NOT NULL").distinct()


def max_lifetime(log: ObjectLog, object_type: str) -> DataFrame:
    """Longest time from an object's own time to its last event, in seconds."""
    last = log.links().groupBy("object_id").agg(F.max("time").alias("last"))
    objects = log.objects_of(object_type).select("object_id", "time")
    return objects.join(last, "object_id").agg(
        F.max(seconds_between(F.col("last"), F.col("time"))).alias("max_seconds")
    )


def max_interevent(log: ObjectLog, object_type: str) -> DataFrame:
    """Longest gap between two consecutive events of one object, in seconds.

    Equal times give no gap, so the events of an object at one time are folded first.
    """
    times = log.links().groupBy("object_id", "time").agg(F.count(F.lit(1)).alias("n"))
    times = times.join(log.objects_of(object_type).select("object_id"), "object_id", "left_semi")
    gaps = lagged(times, "object_id", ["time"], "time", 1)
    between = F.max(seconds_between(F.col("time"), F.col("lag_1")))
    repeated = F.max(F.when(F.col("n") > 1, 0.0))
    return gaps.agg(F.greatest(between, repeated).alias("max_seconds"))


def duration(frame: DataFrame, what: str) -> timedelta:
    """The single value of a duration frame; an error when there is none."""
    seconds = frame.first()[0]
    if seconds is None:
        raise ValueError(f"No events to derive {what} from.")
    return timedelta(seconds=float(seconds))


def describe_types(log: ObjectLog, entity: str, descriptions: DataFrame) -> DataFrame:
    """Types with their text from a dimension table (type, description)."""
    return types(log, entity).join(descriptions.select("type", "description"), "type", "left")


def _inferred(field: T.StructField) -> str | None:
    kind = field.dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(kind, T.BooleanType):
        return "categorical"
    if isinstance(kind, T.NumericType):
        return "numerical"
    return None


def column_roles(
    log: ObjectLog,
    overrides: Mapping[str, Mapping[str, str]] | None = None,
    *,
    few_values: int = 20,
) -> DataFrame:
    """table, column, role, non_null: one pass per table.

    `overrides` maps a table name or glob to {column: role}. A categorical
    override is skipped for a column without any value. Strings with few distinct
    values are categorical, other strings text.
    """
    parts = []
    for table, df in log.tables.items():
        strings = [f.name for f in df.schema.fields if _inferred(f) is None]
        stats = df.agg(
            *[F.count(quoted(c)).alias(f"n_{i}") for i, c in enumerate(df.columns)],
            *[F.approx_count_distinct(quoted(c)).alias(f"d_{i}") for i, c in enumerate(df.columns) if c in strings],
        )
        rows = []
        for i, field in enumerate(df.schema.fields):
            role = _inferred(field)
            column = F.lit(role) if role else F.when(F.col(f"d_{i}").between(1, few_values), "categorical").otherwise("text")
            if field.name == "time":
                column = F.lit("timestamp")
            for pattern, chosen in (overrides or {}).items():
                if field.name in chosen and (pattern == table or fnmatch(table, pattern)):
                    wanted = chosen[field.name]
                    if wanted == "categorical":
                        column = F.when(F.col(f"n_{i}") == 0, column).otherwise(F.lit(wanted))
                    else:
                        column = F.lit(wanted)
            rows.append(
                F.struct(
                    F.lit(field.name).alias("column"),
                    column.alias("role"),
                    F.col(f"n_{i}").alias("non_null"),
                )
            )
        parts.append(stats.select(F.lit(table).alias("table"), F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)
