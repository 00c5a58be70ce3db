"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_TOKEN = "__INVALID__"
NO_TIME = -(2**63)
_EPOCH = datetime(1970, 1, 1)


def micros(value: datetime | timedelta) -> int:
    """Whole microseconds of a duration, or since 1970 of a time."""
    span = value - _EPOCH if isinstance(value, datetime) else value
    return span // timedelta(microseconds=1)


def whole_seconds(value: timedelta) -> timedelta:
    """Durations count in whole seconds."""
    return timedelta(seconds=int(value.total_seconds()))


def to_micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (to_micros(later) - to_micros(earlier)) / F.lit(1e6)


def hours_between(later: Column, earlier: Column) -> Column:
    return (to_micros(later) - to_micros(earlier)) / F.lit(3.6e9)


def unix_seconds(at: Column) -> Column:
    """Whole seconds since 1970; a missing time is the smallest long."""
    return F.coalesce(F.unix_seconds(at.cast("timestamp")), F.lit(NO_TIME).cast("long"))


def normalize_token(value: Column, empty: str = EMPTY_TOKEN) -> Column:
    text = F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.nullif(F.translate(text, "|", "_"), F.lit("")), F.lit(empty))


def type_in(column: Column, types: str | Iterable[str] | None) -> Column:
    if types is None:
        return F.lit(True)
    return column.isin([types] if isinstance(types, str) else list(types))


def class_index(column: Column, classes: Sequence[str]) -> Column:
    """Position in the class list, null when it is not in there."""
    pairs = F.array(*[F.lit(c) for c in classes])
    return F.nullif(F.array_position(pairs, column), F.lit(0)).cast("int") - 1


def fresh(state_time: Column, at: Column, max_age: timedelta | None) -> Column:
    if max_age is None:
        return F.lit(True)
    return to_micros(state_time) > to_micros(at) - micros(whole_seconds(max_age))


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return normalized(shifted)


def uniform(seed: Column | int, *columns: Column | str) -> Column:
    """A repeatable number in [0, 1): the first 52 bits of an md5 of the seed and the columns, as any engine can make it."""
    code = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *columns))
    return F.conv(F.substring(code, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def normalized(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(
        total == 0, F.transform(values, lambda x: F.lit(1.0) / F.size(values))
    ).otherwise(F.transform(values, lambda x: x / total))


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def argmax(scores: Column) -> Column:
    """Index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_hot(index: Column, width: int) -> Column:
    return F.array(*[F.when(index == k, 1.0).otherwise(0.0) for k in range(width)])


def postprocess(score: Column, task_type: str) -> Column:
    """Raw model output to a prediction of the task's kind."""
    if task_type == "binary":
        return sigmoid(score)
    if task_type == "multilabel":
        return F.transform(score, sigmoid)
    if task_type == "multiclass":
        return softmax(score)
    return score
